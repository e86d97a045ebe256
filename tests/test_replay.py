"""Replays of tables in several files a batch."""

import glob

from pyspark.sql import functions as F

from catalog import streams
from scenelake.session import shared_folder


def test_a_large_batch_is_dealt_over_files_and_nothing_is_lost(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100, raising=False)
    rows = streams.timed(spark.range(3000).select(F.col("id").alias("track_id"), (F.col("id") * 100_000).alias("t_us")))
    known = set(glob.glob(f"{shared_folder(spark)}/replay/*"))
    out = streams.drained(streams.replay(rows, track_id=-1).withWatermark("timestamp", "1 hour"))
    assert sorted(r["track_id"] for r in out.collect()) == [-1, *range(3000)]
    (path,) = set(glob.glob(f"{shared_folder(spark)}/replay/*")) - known
    assert len(glob.glob(f"{path}/*.parquet")) > 20
