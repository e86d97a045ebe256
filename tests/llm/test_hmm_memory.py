from collections import Counter

import numpy as np
import pyarrow as pa

from llm import hmm


class _Taken:
    def mapInArrow(self, run, schema):
        return run


def test_words_of_one_large_batch_leave_before_all_are_held(monkeypatch):
    monkeypatch.setattr(hmm, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(hmm, "HELD_WORDS", 1_000, raising=False)
    texts = [" ".join(f"w{(7 * i + k) % 9_000}" for k in range(100)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300) % 2), pa.array(texts), pa.array([True] * 300)], ["grp", "text", "train"])
    out = list(hmm._local_counts(_Taken())(iter([batch])))
    assert max(b.num_rows for b in out) <= 1_500
    got = Counter()
    for b in out:
        for g, h, n in zip(*(b.column(c).to_pylist() for c in ("grp", "hash", "n")), strict=True):
            got[g, h] += n
    words = Counter((i % 2, w) for i, t in enumerate(texts) for w in t.split())
    assert sorted(got.values()) == sorted(words.values())


def test_a_word_counted_twice_in_a_group_scores_as_one(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * k) % 40}" for k in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda: {r["doc_id"]: r for r in hmm.score_documents(docs, states=2, rounds=1).collect()}
    want = score()
    local = hmm._local_counts
    monkeypatch.setattr(hmm, "_local_counts", lambda grouped: local(grouped).selectExpr("grp", "hash", "class", "explode(array(n - int(n / 2), int(n / 2))) as n").selectExpr("grp", "hash", "class", "cast(n as long) as n"))
    got = score()
    same = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert all([got[i][c] for c in same] == [r[c] for c in same] and abs(got[i]["base_score"] - r["base_score"]) < 1e-9 and abs(got[i]["score"] - r["score"]) < 1e-6 for i, r in want.items())
