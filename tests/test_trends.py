"""Series, coverage, baselines and judging, on small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from scenelake.functions.clock import duration_s
from scenelake.operators import baseline as b
from scenelake.operators import series as s
from scenelake.plans import reports as r
from scenelake.plans.analysis import AnalysisSettings, analyse
from scenelake.plans.bounds import bucket_span

T0 = 1_704_067_200
HOUR = 3600


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def observed(spark, counts, motion=("moving", "stationary")):
    rows = [
        (f"e{i}", "cam0", "person", motion[i % 2], 0.4, ["a", "b"], float(T0 + h * HOUR + i)) for h, n in enumerate(counts) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "entity_id string, camera_id string, entity_type string, motion string, speed double, zones array<string>, at double")
    return df.withColumn("timestamp", F.timestamp_micros((F.col("at") * 1e6).cast("long")))


def bare(spark, values, key="c"):
    rows = [(key, i, T0 + i * HOUR, float(v or 0), 0 if v is None else 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "camera_id string, bucket long, at long, value double, samples long")
    return df.select("camera_id", "bucket", F.timestamp_seconds("at").alias("bucket_start"), F.lit(3600.0).alias("width_s"), "value", "samples", F.lit(False).alias("known_zero"))


def values(df, col="value"):
    return [row[0] for row in df.orderBy("bucket").select(col).collect()]


def test_entities_per_hour_with_an_empty_hour(spark):
    out = s.bucket_series(observed(spark, [3, 0, 5]), since=T0, until=T0 + 3 * HOUR).persist()
    assert values(out) == [3.0, 0.0, 5.0]
    assert [bool(x) for x in values(out.withColumn("e", s.empty()), "e")] == [False, True, False]


def test_fraction_moving_counts_every_row(spark):
    out = s.bucket_series(observed(spark, [4]), "moving_fraction", since=T0, until=T0 + HOUR)
    assert values(out) == [0.5]
    out = s.bucket_series(observed(spark, [4], motion=("moving", None)), "moving_fraction", since=T0, until=T0 + HOUR)
    assert values(out) == [0.5]


def test_speed_of_rows_without_any_is_zero_but_sampled(spark):
    df = observed(spark, [2]).withColumn("speed", F.lit(None).cast("double"))
    row = s.bucket_series(df, "mean_speed", since=T0, until=T0 + HOUR).first()
    assert (row.value, row.samples) == (0.0, 2)


def test_windows_are_refused_when_inverted_or_too_wide():
    with pytest.raises(ValueError):
        bucket_span(10, 5, 0, 1)
    with pytest.raises(ValueError):
        bucket_span(0, 1e9, 0, 1)
    assert bucket_span(-1, 3600, 0, 3600) == (-1, 0)


def test_metric_filters_and_averages(spark):
    with pytest.raises(ValueError):
        s.bucket_series(observed(spark, [1]), "events", since=T0, until=T0 + HOUR, entity_type="person")
    with pytest.raises(ValueError):
        s.rebucket(bare(spark, [1, 2]), 2, "mean_speed")
    with pytest.raises(ValueError):
        s.metric_named("nope")


@pytest.mark.parametrize(
    "series, reach, want",
    [([5, None, 5], 2, [False, True, False]), ([5, None, None, None], 2, [False] * 4), ([5, *[None] * 9, 5], 2, [False] * 11), ([5, None, None, 5], 2, [False, True, True, False])],
)
def test_neighbours_tell_zero_from_unknown(spark, series, reach, want):
    assert values(s.mark_observed_zeros(bare(spark, series), ["camera_id"], reach), "known_zero") == want


def test_heartbeats_settle_what_neighbours_cannot(spark):
    ser, grid = bare(spark, [5, *[None] * 9, 5]), s.Grid(float(T0), 3600.0, 0, 10)
    beats = spark.createDataFrame([("c", T0 + i * HOUR + 60) for i in range(11)], "camera_id string, at long").select("camera_id", F.timestamp_seconds("at").alias("timestamp"))
    assert values(s.mark_alive(ser, beats, grid, ["camera_id"]), "known_zero") == [False] + [True] * 9 + [False]
    other = beats.withColumn("camera_id", F.lit("elsewhere"))
    assert not any(values(s.mark_alive(ser, other, grid, ["camera_id"]), "known_zero"))


def test_one_spike_is_found_and_nothing_else(spark):
    v = [10.0] * (28 * 24)
    v[300] = 90.0
    ser = bare(spark, v)
    out = b.detect(ser, b.learn_baseline(ser, ["camera_id"]), ["camera_id"]).where("verdict = 'anomaly'").collect()
    assert [(x.bucket, x.direction, x.severity) for x in out] == [(300, "above", "high")]


def test_a_dead_hour_is_below(spark):
    v = [40.0 + i % 5 for i in range(28 * 24)]
    v[400] = 0.0
    ser = bare(spark, v)
    out = b.detect(ser, b.learn_baseline(ser, ["camera_id"]), ["camera_id"]).where("verdict = 'anomaly'").collect()
    assert [(x.bucket, x.direction) for x in out] == [(400, "below")]


def test_two_buckets_of_history_judge_nothing(spark):
    ser = bare(spark, [10.0, 10.0])
    out = b.detect(ser, b.learn_baseline(ser, ["camera_id"]), ["camera_id"])
    assert {x.verdict for x in out.collect()} == {"unjudged"}
    rep = r.analysis_report(out, ["camera_id"]).first()
    assert rep.nothing_judged and rep.anomalies == 0


def test_a_silent_camera_is_still_in_the_window(spark):
    day = 86_400
    o = observed(spark, [5] * (24 * 20))
    beats = spark.createDataFrame([("cam0", T0 + i * HOUR + 5) for i in range(24 * 21)], "camera_id string, at long").select("camera_id", F.timestamp_seconds("at").alias("timestamp"))
    out = analyse(
        o, since=T0 + 20 * day, until=T0 + 21 * day, keys=["camera_id"], heartbeats=beats, settings=AnalysisSettings(period_hours=24, training_span_s=20.0 * day)
    )
    assert {(x.verdict, x.direction) for x in out.collect()} == {("anomaly", "below")}


def test_settings_that_would_learn_outages_are_refused():
    with pytest.raises(ValueError):
        AnalysisSettings(include_empty_in_training=True, infer_zeros=False)
    with pytest.raises(ValueError):
        AnalysisSettings(period_hours=12)


def test_series_report_says_when_there_is_too_little(spark):
    rep = r.series_report(bare(spark, [3, None, 4]), "entities", ["camera_id"]).first()
    assert rep.too_few and rep.busiest is None and rep.total == 7.0
    rep = r.series_report(bare(spark, [None, None]), "entities", ["camera_id"]).first()
    assert rep.nothing_recorded
    with pytest.raises(ValueError):
        r.check_payload(0, 1e9, 60, "entities")


def test_zone_breakdown_counts_an_entity_in_each_of_its_zones(spark):
    got = {x.zone: x.entities for x in s.zone_breakdown(observed(spark, [3, 2]), ["a", "b", "z"], since=T0, until=T0 + 2 * HOUR).collect()}
    assert got == {"a": 3, "b": 3, "z": 0}


def test_local_slots_follow_the_session_zone(spark):
    from scenelake.functions.clock import next_local_midnight, slot_index

    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    df = spark.sql("select timestamp'2024-03-31 23:30:00' as t")
    row = df.select(slot_index(F.col("t"), 168).alias("w"), (F.unix_seconds(next_local_midnight(F.date_trunc("day", "t"))) - F.unix_seconds(F.date_trunc("day", "t"))).alias("d")).first()
    assert (row.w, row.d) == (6 * 24 + 23, 23 * 3600)


def test_durations():
    assert [duration_s(x) for x in ("30m", "6h", "7d", "4w", "90")] == [1800, 21600, 604800, 2419200, 90]
    for bad in ("5 fortnights", "-1h", ""):
        with pytest.raises(ValueError):
            duration_s(bad)


def test_own_metric(spark):
    s.register_metric("fastest", "observations", lambda: F.max("speed"), is_rate=True)
    assert values(s.bucket_series(observed(spark, [2]), "fastest", since=T0, until=T0 + HOUR)) == [0.4]
