import math
from collections import Counter
from itertools import product

import numpy as np
import pytest

from llm import hmm
from tests.llm import texts


def _model(k=3, m=4, seed=0):
    r = np.random.default_rng(seed)
    return hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(m), k))


def _paths(s, model):
    for path in product(range(len(model.start)), repeat=len(s)):
        p = model.start[path[0]] * model.emit[path[0], s[0]]
        for t in range(1, len(s)):
            p *= model.move[path[t - 1], path[t]] * model.emit[path[t], s[t]]
        yield path, p


def test_likelihood_is_the_sum_over_all_state_paths():
    model, seqs = _model(), [np.array([0, 3, 1, 1]), np.array([2]), np.array([1, 0, 2, 3, 3])]
    want = [math.log10(sum(p for _, p in _paths(s, model))) for s in seqs]
    assert np.allclose(hmm.log_likelihoods(seqs, model), want)


def test_expected_counts_are_those_of_all_state_paths():
    model, seqs = _model(), [np.array([0, 3, 1, 1]), np.array([2]), np.array([1, 0, 2, 3, 3])]
    starts, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s in seqs:
        total = sum(p for _, p in _paths(s, model))
        for path, p in _paths(s, model):
            starts[path[0]] += p / total
            for t, state in enumerate(path):
                emits[state, s[t]] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    for got, want in zip(hmm.expected_counts(seqs, model), (starts, moves, emits), strict=True):
        assert np.allclose(got, want, rtol=1e-4)


def test_contract_columns_and_better_than_the_base(spark):
    rows = texts.documents() + [(100 + i, texts.prose(60, 50 + i % 4), "en", "s", 0) for i in range(60)]
    out = hmm.score_documents(spark.createDataFrame(rows, texts.SHAPE), states=3, rounds=3, group_chars=30_000).collect()
    words = lambda t: [w.lower() for w in texts.WORD.findall(t or "")] + [None]
    counts = Counter()
    for r in rows:
        if not texts.held_out(r[0]):
            counts.update(words(r[1]))
    n, v = sum(counts.values()), len(counts)
    key = lambda x: (str(x[0]), *x[1:4], round(x[4], 6))
    want = sorted(key((r[0], texts.held_out(r[0]), len(w := words(r[1])), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))) for r in rows)
    assert sorted(key((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"])) for r in out) == want
    assert {r["train_tokens"] for r in out} == {n}
    unseen = [r for r in out if r["held_out"] and r["n_tokens"] > 10]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_empty_table_and_no_training_rows(spark):
    assert hmm.score_documents(spark.createDataFrame([], texts.SHAPE)).collect() == []
    held = next(i for i in range(99) if texts.held_out(i))
    row = hmm.score_documents(spark.createDataFrame([(held, "a b", "en", "s", 3)], texts.SHAPE)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] == pytest.approx(row["score"]) and row["score"] <= 0
