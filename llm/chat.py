"""Chat formatting: conversations to one training string with a loss mask, in Spark expressions only.

Template, for each run of adjacent turns of one role::

    <|turn|>ROLE\\n TEXT (<|next|> TEXT)* <|end|>\\n

``&``, ``<`` and the newline of a role are escaped inside texts and roles, so no control string can
come from the data and the output reads back to exactly the turns that went in. Only assistant texts
are under the loss mask: neither their markers nor what stands between two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted``, ``segments`` and ``loss_spans``.

    ``segments`` are structs (text, loss) whose texts concatenate to ``formatted``; ``loss_spans`` are
    (start, length) in code points of ``formatted``. Turns are ordered by turn, role and text (nulls
    first), so ties have one order. A null text is empty, a null role is the empty role, a null
    conversation is a conversation of its own, other columns are ignored; an empty table gives no rows.
    Everything of a turn is computed as a row; a conversation meets in one row only as its output.
    """
    t = turns.select(
        F.col(conv).alias("_c"), F.col(turn).alias("_n"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_r"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")
    )
    order = Window.partitionBy("_c").orderBy("_n", "_r", "_t")
    same_before = F.coalesce(F.lag("_r").over(order) == F.col("_r"), F.lit(False))
    same_after = F.coalesce(F.lead("_r").over(order) == F.col("_r"), F.lit(False))
    opening = F.when(same_before, F.lit(NEXT)).otherwise(F.concat(F.lit(TURN), F.replace(escape(F.col("_r")), F.lit("\n"), F.lit("&nl;")), F.lit("\n")))
    pieces = t.select(
        "_c", F.row_number().over(order).alias("_k"), opening.alias("_o"), escape(F.col("_t")).alias("_b"), F.when(same_after, F.lit("")).otherwise(F.lit(END)).alias("_e"),
        (F.col("_r") == ASSISTANT).alias("_l"),
    )
    before = F.sum(F.length("_o") + F.length("_b") + F.length("_e")).over(Window.partitionBy("_c").orderBy("_k")) - F.length("_b") - F.length("_e")
    placed = pieces.withColumn("_s", before.cast("long"))
    whole = placed.groupBy("_c").agg(F.sort_array(F.collect_list(F.struct("_k", "_o", "_b", "_e", "_l", "_s"))).alias("_a"))
    segments = F.flatten(F.transform("_a", lambda p: F.array(
        F.struct(p["_o"].alias("text"), F.lit(False).alias("loss")), F.struct(p["_b"].alias("text"), p["_l"].alias("loss")), F.struct(p["_e"].alias("text"), F.lit(False).alias("loss"))
    )))
    return whole.select(
        F.col("_c").alias(conv),
        F.concat_ws("", F.transform("_a", lambda p: F.concat(p["_o"], p["_b"], p["_e"]))).alias("formatted"),
        segments.alias("segments"),
        F.transform(F.filter("_a", lambda p: p["_l"]), lambda p: F.struct(p["_s"].alias("start"), F.length(p["_b"]).cast("long").alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that ``formatted`` was made of."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda b: b != "")

    def block(b: Column) -> Column:
        role = unescape(F.replace(F.substring_index(b, "\n", 1), F.lit("&nl;"), F.lit("\n")))
        body = F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b) - F.length(F.substring_index(b, "\n", 1)) - 1 - len(END))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])))
