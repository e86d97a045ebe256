import random
import time

from pyspark.sql import functions as F

from scenelake.operators import linking as ln
from scenelake.session import settle

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
SHAPE = f"source_id string, step long, det_id long, t_us long, box {BOX}, label string, confidence double"


def test_chains_of_slices_are_those_of_the_joins(spark, monkeypatch):
    """Linking inside slices finds the pairs, heads and summaries that the operators over whole tables find, missing numbers and labels included."""
    monkeypatch.setattr(ln, "SLICE_STEPS", 4)
    monkeypatch.setattr(ln, "PAIRS_AT_ONCE", 7)
    draw, rows = random.Random(11), []
    for source in "ab":
        for step in (s for s in range(-3, 40) if s % 13 != 5):
            for i in range(draw.randrange(0, 7)):
                x, side = float(draw.randrange(0, 9) * 10), draw.choice((50.0, 60.0, float("nan"), None) if draw.random() < 0.05 else (50.0,))
                label = None if draw.random() < 0.02 else draw.choice(["person", "laptop"])
                rows.append((source, step, draw.randrange(10**6) * 10 + i, step * 100_000, (x, 0.0, None if side is None else x + side, 90.0), label, draw.choice((0.1, 0.2, 0.3, 0.5, 0.9))))
    dets, s = spark.createDataFrame(rows, SHAPE), ln.LinkSettings()
    links = ln.pair_frames(ln.association_candidates(dets, s))
    nodes = dets.select(*ln.NODE).join(links, list(ln.NODE), "left").withColumn("prev_step", F.when(F.col("prev_id").isNotNull(), F.col("step") - 1))
    chained = settle(dets.join(ln.chain_heads(nodes, ["step", "det_id"], ["prev_step", "prev_id"]), list(ln.NODE)))
    want = ln._tracklets(chained, s).select(*ln._TRACKLET)
    linked = settle(ln._linked(dets, s))
    crossing = settle(ln._over_slices(linked.where("_edge")))
    got = linked.where("not _edge and first_t is not null").select(*ln._TRACKLET).unionByName(ln._tracklets(crossing, s).select(*ln._TRACKLET))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    columns = [*ln._ROW, *ln._CHAIN[1:]]
    got_rows = linked.where("not _edge").select(*columns).unionByName(crossing.select(*columns))
    want_rows = chained.join(want.select(*ln._CHAIN), list(ln._CHAIN), "left_semi").select(*columns)
    assert want_rows.exceptAll(got_rows).isEmpty()
    assert crossing.count() > 50 and linked.where("not _edge and hits > 1").count() > 5


def test_settling_gives_back_its_shuffle_files(spark):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    table = settle(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    assert table.count() == 10
