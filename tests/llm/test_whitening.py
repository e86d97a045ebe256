import math

import numpy as np
from fractions import Fraction

from llm import whitening

SHAPE = "vec_id long, embedding array<float>, label int"


def vectors(n=300, d=7):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 3 + 40
    rows = [(i, v, i % 3) for i, v in enumerate(base.astype(np.float32).tolist())]
    rows += [(0, rows[0][1], 1), (None, rows[5][1], None), (900, [0.0] * d, 1), (901, [-1e-9] * d, 1)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [1.0] * (d - 1) + [None], 1), (1003, [float("nan")] + [1.0] * (d - 1), 1), (1004, [float("inf")] * d, 1), (1005, [1.0] * (d + 1), 1), (1006, [1e30] * d, 1)]
    return rows, bad


def exact(rows):
    """n, the whole numbers, n times them less their sums, and the covariance, in fractions."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v, _ in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    u = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in u), n**3) for j in range(len(sums))] for i in range(len(sums))]
    return n, u, np.array([[float(c) for c in r] for r in cov])


def test_against_exact_fractions(spark):
    rows, bad = vectors()
    docs = spark.createDataFrame([*rows, *bad], SHAPE).repartition(4)
    out, model = whitening.whiten(docs, components=5)
    n, u, cov = exact(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert model.n == n
    assert np.allclose(model.values, values, rtol=1e-12)
    assert np.allclose(model.explained, values / values.sum(), rtol=1e-12)
    got = {(r["vec_id"], r["label"]): r for r in out.collect()}
    assert len(got) == len(rows)
    expected = np.array(u, float) / n @ axes[:, :5] / np.sqrt(values[:5])
    for (i, _, label), far, w in zip(rows, u, expected, strict=True):
        assert int(got[i, label]["deviation"]) == sum(v * v for v in far)
        assert np.allclose(np.abs(got[i, label]["whitened"]), np.abs(w), rtol=1e-9, atol=1e-11)
    assert whitening.identity_error(out.select("x"), model, 5) < 1e-9


def test_one_sign_and_any_partitioning(spark):
    rows, _ = vectors(80, 4)
    docs = spark.createDataFrame(rows, SHAPE)
    a, b = (sorted((r["vec_id"] is None, r["vec_id"] or 0, r["whitened"]) for r in whitening.whiten(docs.repartition(k))[0].collect()) for k in (1, 5))
    assert a == b


def test_numbers_beyond_64_bits_stay_exact(spark):
    rows = [(i, [float((-1) ** i * (1 << 36) + i * 8192), float(i)], 0) for i in range(40)]
    out, model = whitening.whiten(spark.createDataFrame(rows, SHAPE).repartition(3))
    n, u, _ = exact(rows)
    assert {r["vec_id"]: int(r["deviation"]) for r in out.collect()} == {i: sum(v * v for v in far) for i, far in enumerate(u)}


def test_flat_and_empty_tables(spark):
    flat = spark.createDataFrame([(1, [2.0, 2.0], 0), (2, [2.0, 2.0], 0)], SHAPE)
    for docs in (flat, flat.limit(0), flat.limit(1)):
        out, model = whitening.whiten(docs)
        assert model is None and out.count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(9)], SHAPE)
    out, model = whitening.whiten(line)
    assert len(model.values) == 1 and {len(r["whitened"]) for r in out.collect()} == {1}


def test_clashing_names_and_query(spark, tmp_path):
    from llm.registry import Q

    rows, bad = vectors(60, 40)
    docs = spark.createDataFrame([*rows, *bad], SHAPE)
    clash = docs.withColumnRenamed("label", "x").withColumn("whitened", docs["vec_id"])
    assert whitening.whiten(clash)[0].columns == ["vec_id", "embedding", "x", "whitened", "deviation"]
    docs.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Q["op12_whiten"][0](spark, str(tmp_path)).collect()
    assert len(got) == 32 * len(rows) and {r["component"] for r in got} == set(range(1, 33))
    assert {r["n"] for r in got} == {len(rows)} and got[0]["identity_error"] < 1e-4
    flat = spark.createDataFrame([(1, [2.0, 2.0], 0)], SHAPE)
    flat.write.parquet(f"{tmp_path}/flat/embeddings.parquet")
    assert Q["op12_whiten"][0](spark, f"{tmp_path}/flat").count() == 0
