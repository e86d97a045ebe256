"""Live zone rows, contacts, late rows, mergeable counts, null keys and baselines that say what they are of."""

import time
import uuid

import pytest
from pyspark.sql import functions as F

from catalog import scene, streams, views
from scenelake.operators import baseline as b
from scenelake.operators import relations as rel
from scenelake.operators import series as s
from scenelake.operators.zones import Zone
from scenelake.session import shared_folder
from scenelake.sources.store import read_observations
from scenelake.streaming import stateful as st
from scenelake.streaming import windows as sw

SF = "/root/testdata/sf0.001"
FAR = "timestamp'2040-01-01 00:00:00'"


def track(spark, xs, gaps=()):
    """One track whose box stands at ``xs``, ten steps a second; steps in ``gaps`` are missing."""
    rows = [("c", 1, k, (k + 1) * 100_000, "p_1", "person", float(x)) for k, x in enumerate(xs) if k not in gaps]
    df = spark.createDataFrame(rows, "source_id string, track_id long, step long, t_us long, entity_id string, label string, x double")
    box = F.struct((F.col("x") - 10).alias("x1"), F.lit(100.0).alias("y1"), (F.col("x") + 10).alias("x2"), F.lit(200.0).alias("y2"))
    return streams.timed(df.withColumn("box", box).drop("x"))


def live(df, **options):
    zone = Zone("left", ((0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0)))
    out = streams.drained(st.stream_zone_rows(streams.replay(df, track_id=-1), [zone], hold_s=0.3, lateness="1 hour", **options))
    return [(r.step, r.event, round(r.dwell_s, 1)) for r in out.orderBy("step").collect()]


def test_a_visit_is_entered_held_and_left(spark):
    xs = [500, 100, 100, 100, 100, 100, 100, 500, 500, 500, 500, 500, 100]
    assert live(track(spark, xs)) == [(k, "entered", (k - 1) / 10) for k in range(1, 5)] + [(5, None, 0.4), (6, None, 0.5)] + [(k, "exited", 0.5) for k in (7, 8, 9)] + [(12, "entered", 0.0)]


def test_a_short_absence_does_not_end_a_visit_and_a_gap_in_the_track_does(spark):
    xs = [100, 500, 500, 100, 100, 100]
    assert live(track(spark, xs)) == [(0, "entered", 0.0), (1, "exited", 0.0), (2, "exited", 0.0), (3, "entered", 0.3), (4, None, 0.4), (5, None, 0.5)]
    assert live(track(spark, xs, gaps=(4,)))[-1] == (5, "entered", 0.0)


def test_rows_of_a_silent_track_come_out_on_the_timer(spark):
    """Nothing follows of this track; the clock is moved on by another key alone."""
    assert [r[0] for r in live(track(spark, [100, 100]))] == [0, 1]


def test_a_contact_waits_for_a_pose_that_comes_late_and_does_without_one(spark):
    state = scene._state(spark, SF)
    pairs = rel.pair_join(state.drop("keypoints"))
    poses = state.where("label = 'person'").select("source_id", "track_id", "step", "t_us", "keypoints")
    touch = rel.RelationSettings(interact_s=0.0, interact_distance=1.4)
    batch = rel.interaction(rel.pair_history(state), touch)
    cols = ["source_id", "step", "subject_track", "object_track", "confidence", "duration_s"]
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())
    late = streams.timed(poses).withColumn("timestamp", F.col("timestamp") + F.expr("interval 400 milliseconds")).drop("t_us")
    got = streams.drained(st.stream_interaction(streams.replay(streams.timed(pairs), low=-1), streams.replay(late, 2, track_id=-1), touch, lateness="1 hour"))
    assert rows(got) == rows(batch) and got.count() > 0
    none = streams.drained(st.stream_interaction(streams.replay(streams.timed(pairs), low=-1), streams.replay(late.where("false").unionByName(late.limit(1)), 1, track_id=-1), touch, lateness="1 hour"))
    assert none.where("confidence > 0.5").count() <= 1


def test_late_rows_are_counted_in_a_table(spark):
    log = sw.LateRowLog(spark, f"{shared_folder(spark)}/late/{uuid.uuid4().hex}")
    spark.streams.addListener(log)
    try:
        n = streams.late(spark, SF).first()["dropped"]
        for _ in range(100):  # the listener hears of a batch a little after it ends
            try:
                seen = log.read().agg(F.sum("dropped")).first()[0]
            except Exception:
                seen = None
            if seen == n:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert n > 0 and seen == n


def test_sketches_merge_without_the_rows(spark):
    rows = spark.range(30_000).select(F.timestamp_seconds(F.lit(views.START) + F.col("id") % 7200).alias("timestamp"), F.concat(F.lit("e"), F.col("id") % 9000).alias("entity_id"), (F.col("id") % 3 == 0).cast("string").alias("camera_id"))
    halves = [s.sketch_series(part, since=views.START, until=views.START + 7200, keys=["camera_id"]) for part in (rows.where("pmod(hash(entity_id, timestamp), 2) = 0"), rows.where("pmod(hash(entity_id, timestamp), 2) = 1"))]
    hours = halves[0].unionByName(halves[1])
    both = s.sketch_values(s.merge_sketches(hours, 2, ["camera_id"])).collect()
    exact = {r["camera_id"]: r["n"] for r in rows.groupBy("camera_id").agg(F.count_distinct("entity_id").alias("n")).collect()}
    assert len(both) == 2 and all(abs(r["value"] - exact[r["camera_id"]]) <= 4 * r["error"] * exact[r["camera_id"]] for r in both)


def test_a_null_camera_is_a_series_of_its_own(spark):
    o = views.observations(spark, SF)
    hidden = o.withColumn("camera_id", F.expr("nullif(camera_id, 'cam1')"))
    kw = dict(since=views.START, until=views.END, keys=["camera_id"])
    name = F.coalesce("camera_id", F.lit("cam1")).alias("camera_id")
    a, c = (sorted(map(tuple, s.bucket_series(x, "entities", **kw).select(name, "bucket", "value", "samples").collect())) for x in (o, hidden))
    assert a == c
    beats = spark.createDataFrame([(None, views.START)], "camera_id string, t long").withColumn("timestamp", F.timestamp_seconds("t"))
    grid = s.grid_for(o, views.START, views.END, s.HOUR)
    series = s.bucket_series(o.where("false"), "entities", calendar=beats, **kw)
    assert s.mark_alive(series, beats, grid, ["camera_id"]).where("known_zero and camera_id is null").count() == 1


@pytest.mark.parametrize("wrong", [{"metric": "entities"}, {"period_hours": 168}, {"interval_s": 7200.0}])
def test_a_baseline_of_something_else_is_refused(spark, wrong):
    o = views.observations(spark, SF)
    kw = {"metric": "observations", "period_hours": 24, "interval_s": 3600.0}
    made = s.bucket_series(o, kw["metric"], since=views.START, until=views.END, interval_s=kw["interval_s"], keys=["camera_id"])
    base = b.learn_baseline(made, ["camera_id"], period_hours=24, metric="observations")
    assert b.detect(made, base, ["camera_id"], period_hours=24, metric="observations").count() == made.count()
    kw |= wrong
    other = s.bucket_series(o, "observations", since=views.START, until=views.END, interval_s=kw["interval_s"], keys=["camera_id"])
    with pytest.raises(Exception, match="cannot judge"):
        b.detect(other, base, ["camera_id"], period_hours=kw["period_hours"], metric=kw["metric"]).collect()


def test_an_endless_route_gives_its_disk_back(spark):
    """Many small batches leave no settled copy and one staging folder at most behind, and every row once."""
    import os

    base = f"{shared_folder(spark)}/route/{uuid.uuid4().hex}"
    rows = views.observations(spark, SF).limit(36).select("id", "timestamp", "camera_id", "entity_id", "entity_type", "motion", "speed", "zones", "frame_index")
    mixed = rows.select(F.lit("observations").alias("kind"), F.struct(*rows.columns).alias("observations")).repartition(12)
    mixed.write.parquet(f"{base}/in")
    before = set(os.listdir(f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}")) if os.path.isdir(f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}") else set()
    stream = spark.readStream.schema(mixed.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sw.stream_route(stream, f"{base}/store", f"{base}/ck", every=None).awaitTermination()
    after = set(os.listdir(f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}"))
    assert after == before and len(os.listdir(f"{base}/ck/staged")) == 1
    assert read_observations(spark, f"{base}/store").count() == 36


def test_characterising_a_steady_series(spark):
    """A series without noise raises no alarm; a rise past its floor is always seen, and nothing comes of no series."""
    rows = spark.range(24 * 30).select(F.lit("c").alias("camera_id"), F.timestamp_seconds(F.lit(views.START) + F.col("id") * 3600).alias("bucket_start"), F.lit(3600.0).alias("width_s"), F.lit(10.0).alias("value"), F.lit(4).cast("long").alias("samples"), F.lit(False).alias("known_zero"))
    r = b.characterise(rows, ["camera_id"], trials=5, training=6, sizes=(1.0, 0.1)).first()
    assert (r["false_alarms_per_week"], r["worst_week"], r["seen_half"], r["seen_mostly"]) == (0.0, 0.0, 1.0, 1.0)
    assert [(h["size"], h["rate"]) for h in r["hit_rates"]] == [(0.1, 0.0), (1.0, 1.0)]
    assert b.characterise(rows.limit(0), ["camera_id"]).count() == 0
    assert b.characterise(rows.drop("camera_id"), trials=2, training=4).count() == 1
