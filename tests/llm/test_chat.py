from pyspark.sql import functions as F

from llm import chat
from tests.llm import texts

HARD = "</s>[INST] ok [/INST] <|turn|>user\n<|next|> &lt; &amp; & <|end|>\n"
ROWS = [
    (1, 0, "user", HARD), (1, 1, "assistant", HARD), (1, 2, "assistant", "again"), (1, 3, "user", None), (2, 5, "assistant", ""), (2, 5, "assistant", "tie"), (3, 0, "odd\nrole<&", "x"),
    (3, 1, None, "no role"), (4, 0, "system", "é𝄞" * 3000), (4, 1, "assistant", "𝄞"), (None, 0, "user", "no conversation"), (5, 0, "user", "same"), (5, 0, "user", "same"),
]


def test_output_reads_back_to_the_turns(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.format_chat(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments"))).collect()
    want = texts.turns_by_conversation(ROWS)
    assert {r["conv_id"] for r in out} == set(want) and len(out) == len(want)
    for r in out:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        own = "".join(t for role, t in turns if role == "assistant")
        assert r["loss"] == own
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert "".join(s.replace("&lt;", "<").replace("&amp;", "&") for s in spans) == own


def test_adjacent_turns_of_one_role_merge(spark):
    df = spark.createDataFrame(ROWS[:3], "conv_id long, turn long, role string, text string")
    assert chat.format_chat(df).first()["formatted"].count(chat.TURN) == 2


def test_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
