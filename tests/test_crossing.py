"""Slices that nothing enters."""

from pyspark.sql import functions as F

from scenelake.operators import activity, motion, presence
from scenelake.plans.greedy import greedy_spacing
from scenelake.plans.segments import carry, crossing, hold_state


def _rows(spark):
    """Three keys: one within a slice of 1000, one over many, one that begins anew."""
    at = [("a", 0, t) for t in range(0, 900, 100)] + [("b", 500, t) for t in range(500, 5000, 130)] + [("c", 3100, t) for t in range(3100, 3900, 70)]
    return spark.createDataFrame(at, "k string, began long, t long")


def test_what_enters_a_slice_is_the_same_where_only_crossing_keys_are_carried(spark):
    rows = _rows(spark)
    among = crossing(rows, ["k"], "t", "began", 1000)
    assert [r["k"] for r in among.collect()] == ["b"] and crossing(rows.where("k <> 'b'"), ["k"], "t", "began", 1000) is None
    for some, keys in ((rows, among), (rows.where("k <> 'b'"), None)):
        made = [
            (carry(some, ["k"], ["t"], sums={"s": F.col("t")}, befores={"p": F.col("t")}, tops={"m": F.col("t")}, width=1000, among=a),
             hold_state(some, ["k"], "t", F.when(F.col("t") % 300 == 0, F.col("t") % 2700), state="st", since="since", previous="was", width=1000, among=a))
            for a in ("all", keys)
        ]
        for plain, short in zip(*made, strict=True):
            assert sorted(map(str, plain.collect())) == sorted(map(str, short.select(plain.columns).collect()))


def test_spacing_over_slices_is_that_of_a_walk(spark):
    out = greedy_spacing(_rows(spark).withColumn("gap", F.lit(400).cast("long")), ["k"], "t", "gap", width=1000)
    kept: dict[str, list] = {}
    for r in sorted(out.collect(), key=lambda r: (r["k"], r["t"])):
        last = kept.setdefault(r["k"], [])
        assert r["kept"] == (not last or r["t"] - last[-1] >= 400)
        if r["kept"]:
            last.append(r["t"])


def test_the_posture_pass_of_activities_is_written_once(spark):
    box = F.struct(*[F.lit(float(x)).alias(n) for n, x in (("x1", 0), ("y1", 0), ("x2", 50), ("y2", 120))])
    rows = spark.range(30).select(
        F.lit("cam").alias("source_id"), F.lit(1).cast("long").alias("track_id"), F.col("id").alias("step"), (F.col("id") * 100_000).alias("t_us"), F.lit(100_000).cast("long").alias("elapsed_us"),
        F.lit("e").alias("entity_id"), F.lit("person").alias("label"), box.alias("box"), F.lit(30.0).alias("vx"), F.lit(0.0).alias("vy"),
    )
    out = activity.activities(motion.motion_state(presence.presence_islands(rows), with_distance=False))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() >= 30
