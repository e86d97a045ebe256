from hypothesis import given, settings
from hypothesis import strategies as st

from llm import decontaminate as dc
from tests.llm import texts


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        above, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (c != d)))
    return min(row), row.index(min(row))


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=14), st.text("abc ", max_size=30))
def test_myers_is_the_edit_distance(item, text):
    assert dc.myers(dc.masks(item), len(item), text) == _distance(item, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 999), st.lists(st.tuples(st.floats(0, 0.999), st.sampled_from("sdi")), max_size=6))
def test_every_item_within_its_budget_is_found(seed, edits):
    item = dc.normal(texts.prose(25, seed))
    budget, changed = int(0.05 * len(item)), list(item)
    for where, kind in edits[:budget]:
        i = int(where * len(changed))
        changed[i : i + (kind != "i")] = {"s": ["z"], "d": [], "i": ["z"]}[kind]
    text = dc.normal(texts.prose(40, seed + 1) + " " + "".join(changed) + " " + texts.prose(40, seed + 2))
    found = dc.Matcher([(1, item, budget)]).find(text)
    assert found and found[0][1] == _distance(item, text)[0] <= budget


def test_tables(spark):
    item, other = texts.prose(40, 70), texts.prose(40, 71)
    items = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "too few"), (None, other)], "item_id long, text string")
    rows = [(1, "x " + item.upper().replace(" ", "\n\t"), "a"), (2, texts.prose(300, 72), "b"), (3, None, "c"), (4, "", "d"), (None, other[:-1] + "q end", "e"), (5, texts.prose(9000, 73) + " " + item, "f"), (5, texts.prose(9000, 73) + " " + item, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    for chars in (10, 2_000_000):  # many blocks, one block
        out = {(r["doc_id"], r["text"]): [(h["item_id"], h["distance"]) for h in r["hits"]] for r in dc.find_items(docs, items, block_chars=chars).collect()}
        assert sorted(out[1, rows[0][1]]) == [(1, 0), (2, 0)] and out[None, rows[4][1]] == [(None, 1)] and sorted(out[5, rows[5][1]]) == [(1, 0), (2, 0)]
        assert out[2, rows[1][1]] == out[3, None] == out[4, ""] == []
    assert sorted(r["hits"] for r in dc.decontaminate(docs, items).collect()) == ["b", "c", "d"]
    assert dc.decontaminate(docs.limit(0), items).count() == 0 and dc.decontaminate(docs, items.limit(0)).count() == 7


def test_short_items_and_items_without_blanks_are_found(spark):
    chinese = "".join(chr(0x4E00 + (i * i * 37 + i * 11) % 5000) for i in range(300))
    items = spark.createDataFrame([(1, "Who wrote Emma?"), (2, chinese), (3, "cat"), (4, "光合作用"), (5, "an uncommonlylongword with moreletters"), (6, " "), (7, "")], "item_id long, text string")
    wrong = chinese[:150] + "x" + chinese[151:]
    rows = [(1, "He asked: who  wrote\nEMMA? Nobody knew."), (2, "问" + wrong + "答"), (3, "concatenate cats scat"), (4, "cats, (Cat)"), (5, "什么是光合作用呢"), (6, "an uncomonlylongword with moreletters"), (7, " "), (8, texts.prose(80, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (10, 2_000_000):
        out = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits"]] for r in dc.find_items(docs, items, block_chars=chars).collect()}
        assert out == {1: [(1, 0)], 2: [(2, 1)], 3: [], 4: [(3, 0)], 5: [(4, 0)], 6: [(5, 1)], 7: [], 8: []}
    assert {r["doc_id"] for r in dc.decontaminate(docs, items).collect()} == {3, 7, 8}
