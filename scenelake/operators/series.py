"""Bucketed time series: one row per bucket, complete, with empty told apart from unknown.

Columns: the series keys, ``bucket`` (index from the origin), ``bucket_start``, ``width_s``,
``value``, ``samples``, ``known_zero``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.clock import bucket_index, epoch_s, us
from scenelake.plans.bounds import MAX_BUCKETS, bucket_span
from scenelake.plans.joins import join_on

HOUR = 3600.0
DAY = 86_400.0
WEEK = 7 * DAY


@dataclass(frozen=True)
class Metric:
    """How a bucket's value is computed, from which table, and whether it is an average."""

    name: str
    table: str
    value: Callable[[], Column]
    is_rate: bool = False


METRICS: dict[str, Metric] = {}


def register_metric(name: str, table: str, value: Callable[[], Column], is_rate: bool = False) -> None:
    """Add a metric; ``value`` returns any Spark aggregate over ``observations`` or ``events``."""
    if table not in ("observations", "events"):
        raise ValueError(f"metric {name!r}: table must be observations or events")
    METRICS[name] = Metric(name, table, value, is_rate)


register_metric("entities", "observations", lambda: F.count_distinct("entity_id"))
register_metric("entities_approx", "observations", lambda: F.approx_count_distinct("entity_id", 0.02))
register_metric("observations", "observations", lambda: F.count(F.lit(1)))
register_metric("events", "events", lambda: F.count(F.lit(1)))
register_metric("mean_speed", "observations", lambda: F.avg("speed"), is_rate=True)
register_metric(
    "moving_fraction",
    "observations",
    lambda: F.sum(F.when(F.col("motion") == "moving", 1).otherwise(0)) / F.count(F.lit(1)),
    is_rate=True,
)


def metric_named(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; available: {', '.join(METRICS)}")
    return METRICS[name]


@dataclass(frozen=True)
class Grid:
    """A run of whole buckets, computed on the driver from numbers alone."""

    origin_s: float
    width_s: float
    first: int
    last: int

    @property
    def count(self) -> int:
        return self.last - self.first + 1

    @property
    def start_s(self) -> float:
        return self.origin_s + self.first * self.width_s

    @property
    def end_s(self) -> float:
        return self.origin_s + (self.last + 1) * self.width_s

    def holds(self, ts: Column) -> Column:
        """``start <= ts < end`` on the raw column, so it reaches the scan."""
        lo, hi = (F.timestamp_micros(F.lit(us(s))) for s in (self.start_s, self.end_s))
        return (ts >= lo) & (ts < hi)


def midnight_before(df: DataFrame, since_s: float) -> float:
    """Local midnight at or before an instant, in the session time zone; computes no data."""
    spark = df.sparkSession
    row = spark.range(1).select(
        F.unix_micros(F.date_trunc("day", F.timestamp_micros(F.lit(us(since_s))))).alias("m")
    ).first()
    return row["m"] / 1e6


def grid_for(df: DataFrame, since_s: float, until_s: float, width_s: float, origin_s: float | None = None, ceiling: int = MAX_BUCKETS) -> Grid:
    if width_s <= 0:
        raise ValueError(f"bucket width must be positive, got {width_s}")
    origin = midnight_before(df, since_s) if origin_s is None else origin_s
    return Grid(origin, width_s, *bucket_span(since_s, until_s, origin, width_s, ceiling))


def restricted(df: DataFrame, metric: Metric, camera: str | None, entity_type: str | None, zone: str | None) -> DataFrame:
    """The optional filters of a series; a zone is list membership in observations, equality in events."""
    if camera:
        df = df.where(F.col("camera_id") == camera)
    if entity_type:
        if metric.table != "observations":
            raise ValueError(f"entity_type does not apply to {metric.name}")
        df = df.where(F.col("entity_type") == entity_type)
    if zone:
        inside = F.array_contains("zones", zone) if metric.table == "observations" else F.col("zone") == zone
        df = df.where(inside)
    return df


def _filled(counted: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """Every position 0..total-1 per key. Each row also stands for the empty run after it.

    The positions per key are bounded by the bucket ceiling, so a key fits one task.
    """
    if not keys:
        axis = counted.sparkSession.range(total).withColumnRenamed("id", "_pos")
        full = axis.join(counted, "_pos", "left")
        return full.withColumns(
            {"value": F.coalesce("value", F.lit(0.0)), "samples": F.coalesce("samples", F.lit(0).cast("long"))}
        )
    order = Window.partitionBy(*keys).orderBy("_pos")
    upto = F.coalesce(F.lead("_pos").over(order), F.lit(total).cast("long")) - 1
    start = F.when(F.lag("_pos").over(order).isNull(), F.lit(0).cast("long")).otherwise(F.col("_pos"))
    runs = counted.withColumns({"_from": start, "_to": upto})
    runs = runs.withColumn("_at", F.explode(F.sequence("_from", "_to")))
    here = F.col("_at") == F.col("_pos")
    return runs.select(
        *keys,
        F.col("_at").alias("_pos"),
        F.when(here, F.col("value")).otherwise(0.0).alias("value"),
        F.when(here, F.col("samples")).otherwise(F.lit(0).cast("long")).alias("samples"),
    )


def bucket_parts(df: DataFrame, metric: Metric, parts: Sequence[tuple[str, Grid]], keys: Sequence[str], calendar: DataFrame | None = None) -> DataFrame:
    """Several grids in one scan and one aggregation; column ``part`` tells them apart.

    Keys of ``calendar`` have all their buckets even without a row. A null key is a series of its own.
    """
    ts, epoch = F.col("timestamp"), epoch_s(F.col("timestamp"))
    within, base, position = None, 0, []
    for _, grid in parts:
        inside = grid.holds(ts)
        index = bucket_index(epoch, grid.origin_s, grid.width_s) - grid.first + base
        position.append(F.when(inside, index))
        within = inside if within is None else within | inside
        base += grid.count
    rows = df.where(within)
    if len(parts) == 1:
        rows = rows.withColumn("_pos", position[0])
    else:
        rows = rows.withColumn("_pos", F.explode(F.array_compact(F.array(*position))))
    counted = rows.groupBy(*keys, "_pos").agg(
        F.coalesce(metric.value().cast("double"), F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("samples")
    )
    if keys and calendar is not None:
        zero = calendar.select(*keys).distinct().withColumns({"_pos": F.lit(0).cast("long"), "value": F.lit(0.0), "samples": F.lit(0).cast("long")})
        counted = counted.unionByName(zero).groupBy(*keys, "_pos").agg(F.sum("value").alias("value"), F.sum("samples").alias("samples"))
    full = _filled(counted, keys, base)
    part, bucket, start, offset = None, None, None, 0
    for name, grid in parts:
        local = F.col("_pos") - offset + grid.first
        begin = F.timestamp_micros((F.lit(us(grid.origin_s)) + local * us(grid.width_s)).cast("long"))
        here = F.col("_pos") < offset + grid.count
        part = F.when(here, name) if part is None else part.when(here, name)
        bucket = F.when(here, local) if bucket is None else bucket.when(here, local)
        start = F.when(here, begin) if start is None else start.when(here, begin)
        offset += grid.count
    return full.select(
        *keys,
        part.alias("part"),
        bucket.alias("bucket"),
        start.alias("bucket_start"),
        F.lit(float(parts[0][1].width_s)).alias("width_s"),
        "value",
        "samples",
        F.lit(False).alias("known_zero"),
    )


def bucket_series(
    df: DataFrame,
    metric: str = "entities",
    *,
    since: float,
    until: float,
    interval_s: float = HOUR,
    keys: Sequence[str] = (),
    camera: str | None = None,
    entity_type: str | None = None,
    zone: str | None = None,
    origin: float | None = None,
    calendar: DataFrame | None = None,
) -> DataFrame:
    """One metric in contiguous buckets over ``[since, until)`` snapped outward (epoch seconds).

    ``calendar`` lists keys that have a series even without a row, as the cameras of the heartbeats.
    """
    m = metric_named(metric)
    grid = grid_for(df, since, until, interval_s, origin)
    return bucket_parts(restricted(df, m, camera, entity_type, zone), m, [("window", grid)], keys, calendar).drop("part")


def series_rollup(df: DataFrame, dims: Sequence[str], metric: str = "entities", *, since: float, until: float, interval_s: float = HOUR) -> DataFrame:
    """The metric per bucket for every prefix of ``dims``, totals included (occupied buckets only)."""
    m = metric_named(metric)
    grid = grid_for(df, since, until, interval_s)
    rows = df.where(grid.holds(F.col("timestamp"))).withColumn(
        "bucket", bucket_index(epoch_s(F.col("timestamp")), grid.origin_s, grid.width_s)
    )
    sets = [[*dims[:i], "bucket"] for i in range(len(dims), -1, -1)]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *dims, "bucket").agg(
        m.value().cast("double").alias("value"), F.count(F.lit(1)).alias("samples")
    )


def empty() -> Column:
    """No usable reading: no rows, and not known to be zero."""
    return (F.col("samples") == 0) & ~F.col("known_zero")


def mark_alive(series: DataFrame, heartbeats: DataFrame, grid: Grid, keys: Sequence[str] = ()) -> DataFrame:
    """An empty bucket with a heartbeat inside becomes a known zero.

    ``grid`` is the one the series was made on. Heartbeats are matched on ``camera_id`` when the
    series is kept per camera; they shrink to one row per bucket before they meet the series.
    """
    on = [k for k in keys if k == "camera_id"]
    beats = heartbeats.where(grid.holds(F.col("timestamp")))
    index = bucket_index(epoch_s(F.col("timestamp")), grid.origin_s, grid.width_s)
    alive = beats.groupBy(*on, index.alias("bucket")).agg(F.lit(True).alias("_alive"))
    joined = join_on(series, alive, [*on, "bucket"], "left")
    marked = F.col("known_zero") | ((F.col("samples") == 0) & F.coalesce("_alive", F.lit(False)))
    return joined.withColumn("known_zero", marked).select(series.columns)


def mark_observed_zeros(series: DataFrame, keys: Sequence[str] = (), reach: int = 2) -> DataFrame:
    """An empty bucket with recorded activity within ``reach`` buckets on both sides is a known zero."""
    if reach < 1:
        raise ValueError("reach must be at least 1 bucket")
    parts = [c for c in ("part",) if c in series.columns]
    by = Window.partitionBy(*(list(keys) + parts or [F.lit(0)])).orderBy("bucket")
    seen = F.col("samples") > 0

    def near(lo: int, hi: int) -> Column:
        return F.coalesce(F.max(seen).over(by.rowsBetween(lo, hi)), F.lit(False))

    bracketed = ~seen & near(-reach, -1) & near(1, reach)
    return series.withColumn("known_zero", F.col("known_zero") | bracketed)


def rebucket(series: DataFrame, factor: int, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """Merge ``factor`` neighbouring buckets by summing; averages cannot be summed and are refused.

    Summed distinct counts are an upper bound on the distinct count of the wider bucket.
    """
    if metric_named(metric).is_rate:
        raise ValueError(f"{metric} is an average: it cannot be summed across buckets")
    wide = F.floor(F.col("bucket") / factor).cast("long")
    return (
        series.groupBy(*keys, wide.alias("bucket"))
        .agg(
            F.min("bucket_start").alias("bucket_start"),
            (F.first("width_s") * factor).alias("width_s"),
            F.sum("value").alias("value"),
            F.sum("samples").alias("samples"),
            (F.every("known_zero") & (F.sum("samples") == 0)).alias("known_zero"),
        )
    )


SKETCH_LG_K = 12


def sketch_series(
    df: DataFrame, column: str = "entity_id", *, since: float, until: float, interval_s: float = HOUR, keys: Sequence[str] = (), origin: float | None = None, lg_k: int = SKETCH_LG_K
) -> DataFrame:
    """Mergeable distinct counts: per occupied bucket a HyperLogLog ``sketch`` of 2**lg_k registers, and ``samples``.

    Stored, such rows stand for the raw ones: wider buckets, other groupings and later rows are unions of sketches.
    """
    grid = grid_for(df, since, until, interval_s, origin)
    index = bucket_index(epoch_s(F.col("timestamp")), grid.origin_s, grid.width_s)
    rows = df.where(grid.holds(F.col("timestamp"))).groupBy(*keys, index.alias("bucket")).agg(F.hll_sketch_agg(column, F.lit(lg_k)).alias("sketch"), F.count(F.lit(1)).alias("samples"))
    start = F.timestamp_micros((F.lit(us(grid.origin_s)) + F.col("bucket") * us(grid.width_s)).cast("long"))
    return rows.select(*keys, "bucket", start.alias("bucket_start"), F.lit(float(interval_s)).alias("width_s"), "sketch", "samples")


def merge_sketches(sketches: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """``factor`` neighbouring buckets as one, from their sketches alone; also joins sketches of one bucket written at different times."""
    wide = F.floor(F.col("bucket") / factor).cast("long")
    start = F.timestamp_micros(F.unix_micros("bucket_start") - F.pmod("bucket", F.lit(factor)) * (F.col("width_s") * 1_000_000).cast("long"))
    return sketches.groupBy(*keys, wide.alias("bucket")).agg(
        F.min(start).alias("bucket_start"), (F.first("width_s") * factor).alias("width_s"), F.hll_union_agg("sketch").alias("sketch"), F.sum("samples").alias("samples")
    )


def sketch_values(sketches: DataFrame) -> DataFrame:
    """``value``, the estimated distinct count, and ``error``, its relative standard error, in place of the sketch."""
    registers = F.pow(F.lit(2.0), F.lit(SKETCH_LG_K))
    return sketches.withColumns({"value": F.hll_sketch_estimate("sketch").cast("double"), "error": 1.04 / F.sqrt(registers)}).drop("sketch")


def series_stats(series: DataFrame, keys: Sequence[str] = (), metric: str = "entities") -> DataFrame:
    """Coverage, total, mean of occupied buckets, busiest (over all) and quietest (over occupied) bucket."""
    there = ~empty()
    rank_up = F.struct(F.col("value"), -F.col("bucket"), F.col("bucket_start"))
    rank_down = F.struct(F.col("value"), F.col("bucket"), F.col("bucket_start"))
    total = F.lit(None).cast("double") if metric_named(metric).is_rate else F.sum("value")
    return (
        series.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("buckets"),
            F.count_if(there).alias("occupied"),
            (F.count_if(there) / F.count(F.lit(1))).alias("coverage"),
            total.alias("total"),
            F.coalesce(F.avg(F.when(there, F.col("value"))), F.lit(0.0)).alias("mean"),
            F.max(rank_up).alias("_peak"),
            F.min(F.when(there, rank_down)).alias("_quiet"),
        )
        .withColumns(
            {
                "peak_value": F.col("_peak.value"),
                "peak_start": F.col("_peak.bucket_start"),
                "quiet_value": F.col("_quiet.value"),
                "quiet_start": F.col("_quiet.bucket_start"),
            }
        )
        .drop("_peak", "_quiet")
    )


def gap_report(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many buckets are recorded, known zero and unknown."""
    none = F.col("samples") == 0
    return series.groupBy(*keys).agg(
        F.count_if(~none).alias("recorded"),
        F.count_if(none & F.col("known_zero")).alias("known_zero"),
        F.count_if(none & ~F.col("known_zero")).alias("unknown"),
        F.count(F.lit(1)).alias("total"),
    )


def zone_breakdown(df: DataFrame, zones: Sequence[str], *, since: float, until: float, camera: str | None = None) -> DataFrame:
    """Distinct entities per zone over ``[since, until)``; an entity counts in every zone it was in.

    One pass over the rows; a true distinct over the window itself.
    """
    grid = Grid(since, until - since, 0, 0)
    rows = df.where(grid.holds(F.col("timestamp")))
    if camera:
        rows = rows.where(F.col("camera_id") == camera)
    per = rows.select("entity_id", F.explode(F.array_distinct("zones")).alias("zone")).where(F.col("zone").isin(list(zones)))
    wanted = df.sparkSession.createDataFrame([(z,) for z in dict.fromkeys(zones)], "zone string")
    found = per.groupBy("zone").agg(F.count_distinct("entity_id").alias("entities"))
    return wanted.join(found, "zone", "left").select("zone", F.coalesce("entities", F.lit(0)).cast("long").alias("entities"))
