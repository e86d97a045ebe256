"""The same rows through the batch operator and through a stream give the same result."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from catalog import views
from scenelake.operators import activity as a
from scenelake.operators.motion import motion_state
from scenelake.operators.presence import presence_islands
from scenelake.operators.relations import closing_rate, near_relation, pair_history
from scenelake.operators.rules import debounce
from scenelake.operators.series import bucket_series
from scenelake.session import shared_folder
from scenelake.sources.store import read_events
from scenelake.streaming import stateful as st
from scenelake.streaming import windows as sw

SF = "/root/testdata/sf0.001"


def at(us):
    return F.timestamp_micros(F.col(us) + F.lit(1_700_000_000_000_000))


def as_stream(df, files=2):
    """Files in time order, one per micro-batch, written one after the other so the source reads them so."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/in/{uuid.uuid4().hex}"
    ms = df.withColumn("_at", F.unix_millis("timestamp")).persist()
    lo, hi = ms.agg(F.min("_at"), F.max("_at")).first()
    cuts = [lo + (hi + 1 - lo) * i // files for i in range(files + 1)]
    for start, end in zip(cuts, cuts[1:]):
        part = ms.where((F.col("_at") >= start) & (F.col("_at") < end)).drop("_at")
        if not part.isEmpty():
            part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, mode="append"):
    name = f"t{uuid.uuid4().hex}"
    spark = stream.sparkSession
    where = f"{shared_folder(spark)}/ck/{name}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name)


def rows(df, *cols):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def tracks(spark):
    return views.tracks(spark, SF).where("track_id < 12").withColumn("timestamp", at("t_us")).persist()


def closed(df, files=3, **key):
    """``df`` as a stream in shuffled micro-batches of rows, then a row of another key far in the future, which ends every wait."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/in/{uuid.uuid4().hex}"
    last = df.limit(1).withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in key.items()}).withColumn("timestamp", F.expr("timestamp'2030-01-01 00:00:00'"))
    mixed = df.withColumn("_f", F.pmod(F.xxhash64("timestamp", *key), F.lit(files))).persist()
    for i in range(files):
        mixed.where(F.col("_f") == i).drop("_f").coalesce(1).write.mode("append").parquet(path)
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


LATE = {"lateness": "1 hour"}


def test_motion(tracks):
    batch = motion_state(presence_islands(tracks))
    cols = ["source_id", "track_id", "step", "motion", "dwell_s", "age_s", "distance"]
    assert rows(drain(st.stream_motion_state(closed(tracks, track_id=-1), **LATE)), *cols) == rows(batch, *cols)


def test_activities(tracks):
    state = motion_state(presence_islands(tracks), with_distance=False)
    settings = a.ActivitySettings(loiter_s=0.9)
    cols = ["source_id", "track_id", "step", "activity", "confidence", "duration_s"]
    assert rows(drain(st.stream_activities(closed(state, track_id=-1), settings, **LATE)), *cols) == rows(a.activities(state, settings), *cols)


def test_relations(tracks):
    pairs = pair_history(tracks)
    batch = near_relation(pairs).unionByName(closing_rate(pairs))
    cols = ["step", "relation", "confidence", "duration_s"]
    flat = pairs.select("source_id", "low", "high", "step", "t_us", "separation", at("t_us").alias("timestamp"))
    got = drain(st.stream_relations(closed(flat, low=-1), **LATE))
    assert rows(got, "low", "high", *cols) == rows(batch, "low", "high", *cols)


def test_results_do_not_depend_on_how_rows_are_batched(tracks):
    cols = ["source_id", "track_id", "step", "motion", "dwell_s", "age_s", "distance"]
    batch = motion_state(presence_islands(tracks))
    got = drain(st.stream_motion_state(as_stream(tracks, 4), lateness="0 seconds"))
    some = {r[:3]: r for r in rows(got, *cols)}
    assert some and set(some.values()) <= set(rows(batch, *cols))


def test_pairs_are_formed_per_frame(tracks):
    batch = pair_history(tracks)
    closing = tracks.orderBy("t_us").limit(1).withColumns({"t_us": F.lit(10**12), "step": F.lit(10**9).cast("long"), "track_id": F.lit(10**6).cast("long")})
    fed = tracks.unionByName(closing.withColumn("timestamp", at("t_us")))
    got = drain(sw.stream_pairs(as_stream(fed)))
    assert rows(got, "source_id", "step", "low", "high", "separation") == rows(batch, "source_id", "step", "low", "high", "separation")


def _candidates(tracks, cooldown_us):
    return tracks.where("k % 3 = 0").select(
        "source_id", F.lit("seen").alias("rule"), "entity_id", F.lit(0).cast("long").alias("island"), "step", "t_us", F.lit("z").alias("zone"),
        F.lit(cooldown_us).cast("long").alias("cooldown_us"), "timestamp", F.lit(0).alias("rule_order"), F.lit(None).cast("string").alias("related_id"),
    )


def test_debounce(tracks):
    c = _candidates(tracks, 700_000)
    cols = ["source_id", "entity_id", "step", "fired"]
    assert rows(drain(st.stream_debounce(closed(c, entity_id="nobody"), **LATE)), *cols) == rows(debounce(c), *cols)


def test_a_long_cooldown_outlives_quiet_time(spark):
    t = [0, 100_000_000, 200_000_000, 301_000_000, 3_000_000_000]
    made = spark.createDataFrame([("c", "r", "e" if x < 10**9 else "later", 0, i, x, "z", 300_000_000) for i, x in enumerate(t)], "source_id string, rule string, entity_id string, island long, step long, t_us long, zone string, cooldown_us long")
    got = drain(st.stream_debounce(as_stream(made.withColumn("timestamp", at("t_us")), 5), lateness="1 second"))
    assert [r.fired for r in got.where("entity_id = 'e'").orderBy("t_us").collect()] == [True, False, False, True]


def test_series_counts_each_entity_once(spark):
    o = views.observations(spark, SF)
    last = o.orderBy(F.desc("timestamp")).limit(1).withColumn("timestamp", F.expr("timestamp'2024-03-01 00:00:00'"))
    got = drain(sw.stream_series(as_stream(o.unionByName(last)), interval="6 hours", lateness="1 hour"))
    batch = bucket_series(o, "entities", since=views.START, until=views.END, interval_s=21600.0, keys=["camera_id"]).where("samples > 0")
    cols = ["camera_id", "bucket_start", "value", "samples"]
    assert rows(got, *cols) == rows(batch, *cols)


def test_live_judging_joins_the_stored_baseline(spark):
    from scenelake.operators.baseline import learn_baseline

    o = views.observations(spark, SF)
    series = bucket_series(o, "observations", since=views.START, until=views.END, keys=["camera_id"])
    base = learn_baseline(series, ["camera_id"], period_hours=24)
    got = drain(sw.stream_judge(sw.stream_series(as_stream(o), "observations", interval="1 hour"), base, period_hours=24))
    assert got.where("verdict not in ('normal', 'anomaly', 'unjudged')").count() == 0 and got.where("verdict = 'normal'").count() > 0


def test_visits_close_after_the_hold(spark):
    t = [0, 1_000_000, 2_400_000, 3_900_001, 60_000_000]
    df = spark.createDataFrame([("c", 1, "z", x) for x in t], "source_id string, track_id long, zone string, us long").withColumn("timestamp", at("us"))
    got = drain(sw.stream_closed_visits(as_stream(df), lateness="1 second"))
    assert sorted(r.samples for r in got.collect()) == [1, 3]


def test_sink_writes_a_replayed_batch_once(spark):
    e = views.alerts(spark, SF).select("id", "timestamp", "camera_id", "rule", "severity", "entity_id", "zone", "frame_index")
    base = f"{shared_folder(spark)}/sink/{uuid.uuid4().hex}"
    stream = as_stream(e)
    for _ in range(2):
        q = sw.stream_sink(stream, "events", f"{base}/store", f"{base}/ck", every=None)
        q.awaitTermination(300)
    assert read_events(spark, f"{base}/store").count() == e.count()


def test_liveness_reports_each_camera_alive_then_dark(spark):
    name = f"t{uuid.uuid4().hex}"
    stream = sw.stream_liveness(as_stream(views.beats(spark, SF)), silence_ms=1_500)
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{shared_folder(spark)}/ck/{name}").start()
    try:
        # A processing-time timeout never runs dry, so wait for what must come instead of for the end.
        for _ in range(120):
            seen = sorted((r.status, r.camera_id) for r in spark.table(name).collect())
            if len([x for x in seen if x[0] == "dark"]) >= 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert set(seen) == {(status, f"cam{i}") for status in ("alive", "dark") for i in range(4)}
