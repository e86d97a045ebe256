import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from llm import mixing
from tests.llm import texts


def _times(rate, seed, doc_id):
    u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_counts_invert_the_poisson_distribution(spark):
    rows = texts.documents()
    df = spark.createDataFrame(rows, texts.SHAPE).withColumn("copy", F.lit("clash")).withColumn("cdf", F.lit("mine"))
    weights = {"src0": 3.0, "absent": 5.0}
    mass = Counter()
    for r in rows:
        mass[r[3]] += len(r[1] or "")
    out = mixing.mix_sources(df, weights, epochs=2.0)
    rate = {"src0": 2.0 * sum(mass.values()) / mass["src0"], None: 0.0}
    want = Counter()
    for r in rows:
        want[str(r[0]), r[1]] += _times(rate[r[3]], 17, r[0])
    got = Counter((str(r["doc_id"]), r["text"]) for r in out.collect())
    assert got == +want and set(out.columns) == {*df.columns, "_mix_key"}
    keys = [r["_mix_key"] for r in out.collect()]
    assert keys == sorted(keys)


def test_shares_meet_the_weights(spark):
    rows = [(i, "x" * 50, "en", f"s{i % 3 if i % 7 else 0}", 50) for i in range(6000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, texts.SHAPE), {"s0": 1, "s1": 1, "s2": 2}).groupBy("source").count().collect()
    share = {r["source"]: r["count"] / 6000 for r in out}
    assert all(abs(share[s] - w) < 0.03 for s, w in (("s0", 0.25), ("s1", 0.25), ("s2", 0.5)))


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], texts.SHAPE)).collect() == []
