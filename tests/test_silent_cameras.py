from datetime import datetime, timezone

from scenelake.operators import series as s
from scenelake.plans.analysis import AnalysisSettings, analyse

T0 = 1_704_067_200  # 2024-01-01, midnight UTC
SHAPE = "camera_id string, timestamp timestamp"


def _at(camera, hour):
    return camera, datetime.fromtimestamp(T0 + 3600 * hour + 60, timezone.utc)


def test_a_camera_with_heartbeats_alone_has_a_series_of_known_zeros(spark):
    rows = spark.createDataFrame([_at("a", 1), _at("a", 1), _at("a", 26)], SHAPE)
    beats = spark.createDataFrame([_at("quiet", h) for h in range(48)] + [_at("elsewhen", 900), _at(None, 3)], SHAPE)
    window = dict(since=float(T0), until=float(T0 + 3 * 3600), keys=["camera_id"])
    ser = s.bucket_series(rows, "observations", origin=float(T0), calendar=beats.where("camera_id = 'quiet'"), **window)
    out = s.mark_alive(ser, beats, s.Grid(float(T0), 3600.0, 0, 2), ["camera_id"]).collect()
    assert sorted((r["camera_id"], r["bucket"], r["value"], r["samples"], r["known_zero"]) for r in out) == [
        ("a", 0, 0.0, 0, False), ("a", 1, 2.0, 2, False), ("a", 2, 0.0, 0, False), *[("quiet", b, 0.0, 0, True) for b in range(3)]
    ]
    judged = analyse(rows, "observations", since=float(T0 + 86400), until=float(T0 + 2 * 86400), keys=["camera_id"], settings=AnalysisSettings(period_hours=24, training_span_s=86400.0), heartbeats=beats)
    assert {r["camera_id"]: r["count"] for r in judged.groupBy("camera_id").count().collect()} == {"a": 24, "quiet": 24, None: 24}  # beats without a camera are a series of their own
