"""Queries over stored rows and frames: filters, timelines, snapshots, sampling, assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.clock import epoch_s, us
from scenelake.operators.presence import FRAMES_PER_SLICE, step_ordinal

PAGE_DEFAULT, PAGE_MAX = 50, 500


def _bounded(df: DataFrame, since: float | None, until: float | None, limit: int) -> DataFrame:
    if since is not None and until is not None and since > until:
        raise ValueError("since is after until")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if since is not None:
        df = df.where(F.col("timestamp") >= F.timestamp_micros(F.lit(us(since))))
    if until is not None:
        df = df.where(F.col("timestamp") <= F.timestamp_micros(F.lit(us(until))))
    if "dt" in df.columns:
        if since is not None:
            df = df.where(F.col("dt") >= F.to_date(F.timestamp_micros(F.lit(us(since)))))
        if until is not None:
            df = df.where(F.col("dt") <= F.to_date(F.timestamp_micros(F.lit(us(until)))))
    return df


def _ordered(df: DataFrame, limit: int, newest_first: bool) -> DataFrame:
    order = [F.desc("timestamp"), F.desc("id")] if newest_first else [F.asc("timestamp"), F.asc("id")]
    return df.orderBy(*order).limit(limit)


def _equals(df: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def query_events(
    df: DataFrame,
    *,
    since: float | None = None,
    until: float | None = None,
    camera: str | None = None,
    entity: str | None = None,
    rule: str | None = None,
    severity: str | None = None,
    zone: str | None = None,
    limit: int = 100,
    newest_first: bool = True,
) -> DataFrame:
    """Events meeting every given filter; both ends of the window are included."""
    rows = _bounded(df, since, until, limit)
    rows = _equals(rows, camera_id=camera, entity_id=entity, rule=rule, severity=severity, zone=zone)
    return _ordered(rows, limit, newest_first)


def query_observations(
    df: DataFrame,
    *,
    since: float | None = None,
    until: float | None = None,
    camera: str | None = None,
    entity: str | None = None,
    entity_type: str | None = None,
    zone: str | None = None,
    limit: int = 100,
    newest_first: bool = True,
) -> DataFrame:
    """Observations meeting every given filter; a zone is membership in the row's list."""
    rows = _equals(_bounded(df, since, until, limit), camera_id=camera, entity_id=entity, entity_type=entity_type)
    if zone:
        rows = rows.where(F.array_contains("zones", zone))
    return _ordered(rows, limit, newest_first)


def timeline(df: DataFrame, entity_id: str, limit: int = 500) -> DataFrame:
    """One entity's events, oldest first."""
    return query_events(df, entity=entity_id, limit=limit, newest_first=False)


def timeline_span(events: DataFrame) -> DataFrame:
    """Rows and the seconds they span, 0 with fewer than two."""
    ts = epoch_s(F.col("timestamp"))
    span = F.when(F.count(F.lit(1)) >= 2, F.max(ts) - F.min(ts)).otherwise(0.0)
    return events.agg(F.count(F.lit(1)).alias("events"), span.alias("span_s"))


def time_window(df: DataFrame, lo: float, hi: float) -> DataFrame:
    """Half open: ``lo <= timestamp < hi``."""
    start, end = (F.timestamp_micros(F.lit(us(v))) for v in (lo, hi))
    return df.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def api_page(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A page of 50 by default and 500 at most."""
    n = PAGE_DEFAULT if limit is None else limit
    if n < 1:
        raise ValueError("limit must be at least 1")
    return df.limit(min(n, PAGE_MAX))


def live_snapshot(df: DataFrame) -> DataFrame:
    """The entities of each camera's latest frame, each with its last record there.

    Every camera's latest frame comes from a small aggregate; only rows of those frames are ranked.
    """
    latest = df.groupBy("camera_id").agg(F.max("frame_index").alias("frame_index"))
    now = df.join(latest, ["camera_id", "frame_index"])
    rest = [c for c in df.columns if c not in ("camera_id", "entity_id", "frame_index")]
    last = F.max_by(F.struct(*rest), F.struct("timestamp", "id"))
    return now.groupBy("camera_id", "entity_id", "frame_index").agg(last.alias("_r")).select("camera_id", "entity_id", "frame_index", "_r.*")


def stride_sample(df: DataFrame, n: int) -> DataFrame:
    """Frames whose source index is a multiple of ``n``."""
    if n < 1:
        raise ValueError("stride must be at least 1")
    return df.where(F.pmod("frame_index", F.lit(n)) == 0)


def step_sample(df: DataFrame, n: int = 15, width: int = FRAMES_PER_SLICE) -> DataFrame:
    """Rows of every ``n``-th analysed frame of a source, the first one included."""
    if n < 1:
        raise ValueError("interval must be at least 1")
    frames = df.select("source_id", "frame_index").distinct()
    steps = step_ordinal(frames, ["source_id"], ["frame_index"], width=width)
    return df.join(steps.where(F.pmod("step", F.lit(n)) == 0), ["source_id", "frame_index"])


def heartbeats(frames: DataFrame, interval_s: float = 60.0) -> DataFrame:
    """At most one liveness row per camera and interval, because a frame was completed in it.

    On a fixed grid of intervals rather than spaced from the last row; the rate is the same.
    """
    if interval_s <= 0:
        raise ValueError("interval must be positive")
    cell = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(us(interval_s)))
    return frames.groupBy("camera_id", cell.alias("_c")).agg(F.min("timestamp").alias("timestamp")).drop("_c")


def of_labels(df: DataFrame, *labels: str, column: str = "label") -> DataFrame:
    """Rows of the named classes, whatever the case."""
    return df.where(F.lower(column).isin([n.lower() for n in labels]))


def label_vocabulary(df: DataFrame, column: str = "label") -> DataFrame:
    """Distinct class names in lower case."""
    return df.select(F.lower(column).alias("label")).distinct()


def assemble_observations(
    state: DataFrame,
    *,
    poses: DataFrame | None = None,
    activities: DataFrame | None = None,
    visits: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """The rows to store: state with posture, activities, zones and name where there are any."""
    from scenelake.operators.zones import occupied

    on = ["source_id", "track_id", "step"]
    out = state
    if poses is not None:
        out = out.drop("posture").join(poses.where(F.col("posture") != "unknown").select(*on, "posture"), on, "left")
    if activities is not None:
        doing = activities.where(F.col("activity") != "idle").groupBy(*on).agg(F.array_sort(F.collect_set("activity")).alias("activities"))
        out = out.join(doing, on, "left")
    if visits is not None:
        inside = occupied(visits).groupBy(*on).agg(F.array_sort(F.collect_set("zone")).alias("zones"))
        out = out.join(inside, on, "left")
    if names is not None:
        known = names.where(F.col("name") != "unknown").select("source_id", "track_id", F.col("name").alias("identity"))
        out = out.join(known, ["source_id", "track_id"], "left")
    nothing = F.array().cast("array<string>")
    have = set(out.columns)

    def col(name: str, default=None):
        return F.col(name) if name in have else F.lit(default)

    return out.select(
        F.col("source_id").alias("camera_id"),
        "entity_id",
        col("identity").cast("string").alias("identity"),
        F.col("label").alias("entity_type"),
        "motion",
        F.round("speed", 4).alias("speed"),
        col("posture").cast("string").alias("posture"),
        (F.coalesce("zones", nothing) if "zones" in have else nothing).alias("zones"),
        (F.coalesce("activities", nothing) if "activities" in have else nothing).alias("activities"),
        F.col("step").alias("frame_index"),
        F.round("age_s", 3).alias("elapsed_s"),
    )


def scene_record(visits: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested record of nodes and edges per frame."""
    frame = ["source_id", "step"]
    zone = F.struct("zone", F.col("zone_kind").alias("kind"), F.round("dwell_s", 2).alias("dwell_s"), "event")
    per_entity = visits.groupBy(*frame, "entity_id", F.col("label").alias("entity_type")).agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    nodes = per_entity.groupBy(*frame).agg(F.array_sort(F.collect_list(F.struct("entity_id", "entity_type", "zones"))).alias("nodes"))
    edge = F.struct(
        F.col("subject_id").alias("subject"), "relation", F.col("object_id").alias("object"),
        F.round("distance", 3).alias("distance_heights"), F.round("confidence", 3).alias("confidence"), F.round("duration_s", 2).alias("duration_s"),
    )
    links = edges.groupBy(*frame).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    return nodes.join(links, frame, "full_outer")


def record_json(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The nested record as JSON text."""
    return records.withColumn("record", F.to_json(F.struct(*columns)))


