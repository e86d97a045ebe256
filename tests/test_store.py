"""Retention and once-only writes of the stored tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from scenelake.session import shared_folder
from scenelake.sources import store

START = 1_704_067_200  # 2024-01-01 00:00 UTC


def _events(spark, cameras=("rtsp://a:1", None, "50%=x"), hours=72):
    rows = [(1000 * i + h, c, h) for i, c in enumerate(cameras) for h in range(hours)]
    df = spark.createDataFrame(rows, "id long, camera_id string, h long")
    return df.withColumn("timestamp", F.timestamp_seconds(F.lit(START) + F.col("h") * 3600)).drop("h")


@pytest.fixture
def folder(spark):
    return f"{shared_folder(spark)}/store/{uuid.uuid4().hex}"


def test_prune_counts_rows_and_keeps_the_rest_once(spark, folder):
    store.append_records(_events(spark), "events", folder)
    for cut, gone in ((36, 108), (36, 0), (48, 36), (500, 72)):
        removed = store.prune(spark, folder, {"events": START + cut * 3600.0}).first()["removed"]
        left = store.read_events(spark, folder)
        assert removed == gone
        assert left.count() == left.select("id").distinct().count() == max(0, 3 * (72 - cut))
    assert store.prune(spark, f"{folder}-absent", {"events": 1e10}).first()["removed"] == 0


def test_a_replay_after_any_crash_adds_nothing(spark, folder, monkeypatch):
    df = _events(spark, ("a", "rtsp://b:2", None), 30)
    store.append_once(df, "events", folder, f"{folder}-stage/0")
    store.append_once(df, "events", folder, f"{folder}-stage/0")
    assert store.read_events(spark, folder).count() == 90
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    # A batch staged in full of which only some files were moved when the writer died.
    staged = f"{folder}-stage/1"
    store.append_once(df, "events", f"{folder}-elsewhere", staged)
    first = True
    fs = jvm.Path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listFiles(jvm.Path(f"{folder}-elsewhere/events"), True)
    while files.hasNext():
        path = files.next().getPath()
        inside = path.toString().split("-elsewhere/events/")[1]
        target = jvm.Path(f"{folder}/events/{inside}" if first else f"{staged}/{inside}")
        fs.mkdirs(target.getParent())
        assert fs.rename(path, target)
        first = False
    for _ in range(2):
        store.append_once(df, "events", folder, staged)
        assert store.read_events(spark, folder).count() == 180
