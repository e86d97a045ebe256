"""Counts and run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.operators.presence import FRAMES_PER_SLICE, step_ordinal
from scenelake.plans.segments import SLICE, carry, hold_state

LATENCY_WINDOW = 240
DISABLE_STREAK = 5


def tally(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def majority_class(rows: DataFrame, by: Sequence[str] = ("source_id", "track_id"), order: str = "frame_index") -> DataFrame:
    """The class seen most often per track; of equals the one seen first."""
    votes = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = F.max_by(F.struct("label", "votes"), F.struct(F.col("votes"), -F.col("_first")))
    return votes.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def nearest_rank(ordered: Column, p: float) -> Column:
    """Nearest-rank percentile of a sorted array, the rank rounded half to even."""
    rank = F.greatest(F.lit(1), F.bround(F.lit(p) / 100.0 * F.size(ordered), 0).cast("int"))
    return F.element_at(ordered, F.least(rank, F.size(ordered)))


def latency_summary(timings: DataFrame, by: Sequence[str] = ("stage",), order: str = "seq", value: str = "ms") -> DataFrame:
    """Count, last, mean and maximum over everything; p50 and p95 over the last 240 samples."""
    total = timings.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.max_by(value, order).alias("last_ms"), F.avg(value).alias("mean_ms"), F.max(value).alias("max_ms")
    )
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    recent = timings.withColumn("_r", rank).where(F.col("_r") <= LATENCY_WINDOW)
    window = recent.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("_w"))
    window = window.select(*by, nearest_rank(F.col("_w"), 50).alias("p50_ms"), nearest_rank(F.col("_w"), 95).alias("p95_ms"))
    return total.join(window, list(by))


def rate_summary(ticks: DataFrame, by: Sequence[str] = ("source_id",), time_us: str = "t_us", alpha: float = 0.15) -> DataFrame:
    """Count, mean rate, and the rate from the smoothed interval between ticks.

    The smoothing is a weighted sum: an interval weighs ``alpha * (1 - alpha) ** (intervals after it)``,
    the first one without the factor. So it is a plain aggregate and no key needs one task.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    by = list(by)
    width = 3_600_000_000
    prev = carry(ticks, by, [time_us], befores={"_prev": F.col(time_us)}, width=width).drop(SLICE)
    gap = F.col(time_us) - F.col("_prev")
    steps = prev.withColumn("_gap", gap).where(F.col("_gap") > 0)
    ordered = step_ordinal(steps, by, [time_us], "_i", width=width)
    counted = steps.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    weighted = ordered.join(counted, by)
    weight = F.when(F.col("_i") == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1.0 - alpha), F.col("_n") - 1 - F.col("_i"))
    smooth = weighted.groupBy(*by).agg((F.sum(F.col("_gap") * weight) / 1e6).alias("_smooth"))
    total = ticks.groupBy(*by).agg(F.count(F.lit(1)).alias("ticks"), ((F.max(time_us) - F.min(time_us)) / 1e6).alias("elapsed_s"))
    mean = F.when((F.col("elapsed_s") > 0) & (F.col("ticks") >= 2), (F.col("ticks") - 1) / F.col("elapsed_s")).otherwise(0.0)
    rate = F.when(F.col("_smooth") > 0, 1.0 / F.col("_smooth")).otherwise(0.0)
    return total.join(smooth, by, "left").select(*by, "ticks", "elapsed_s", mean.alias("mean_rate"), rate.alias("rate"))


def stage_health(log: DataFrame, by: Sequence[str] = ("stage",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Calls, failures, the worst run of failures and error types per stage, from a run log
    with ``error_type`` null where the call succeeded."""
    by = list(by)
    failed = F.col("error_type").isNotNull()
    numbered = step_ordinal(log, by, order, "_i")
    runs = hold_state(numbered, by, "_i", failed.cast("int"), state="_f", since="_from", width=FRAMES_PER_SLICE)
    streak = F.when(failed, F.col("_i") - F.col("_from") + 1).otherwise(0)
    total = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(failed).alias("failures"), F.coalesce(F.max(streak), F.lit(0)).alias("worst_streak")
    )
    kinds = log.where(failed).groupBy(*by, "error_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("error_type", "n")))).alias("error_types"))
    out = total.join(kinds, by, "left")
    return out.select(
        *by, "calls", "failures", (F.col("failures") / F.col("calls")).alias("failure_rate"), "worst_streak",
        (F.col("worst_streak") >= DISABLE_STREAK).alias("disabled"), F.coalesce("error_types", F.create_map().cast("map<string,bigint>")).alias("error_types"),
    )


def drop_report(frames: DataFrame) -> DataFrame:
    """Frames a source produced but did not deliver, from the gaps in its frame numbers."""
    produced = F.max("frame_index") - F.min("frame_index") + 1
    return frames.groupBy("source_id").agg(
        F.count_distinct("frame_index").alias("delivered"),
        (produced - F.count_distinct("frame_index")).alias("dropped"),
        ((produced - F.count_distinct("frame_index")) / produced).alias("drop_rate"),
    )


def track_lifetimes(tracks: DataFrame) -> DataFrame:
    """First and last frame, duration and hits of every track."""
    return tracks.groupBy("source_id", "track_id").agg(
        F.min("frame_index").alias("first_frame"),
        F.max("frame_index").alias("last_frame"),
        (F.max("frame_index") - F.min("frame_index") + 1).alias("duration_frames"),
        F.count_if(F.col("time_since_update") == 0).alias("hits"),
    )


def pose_coverage(people: DataFrame, poses: DataFrame, frame: Sequence[str] = ("source_id", "frame_index")) -> DataFrame:
    """People offered, skeletons estimated, and the shortfall per frame."""
    seen = people.groupBy(*frame).agg(F.count(F.lit(1)).alias("people"))
    done = poses.groupBy(*frame).agg(F.count(F.lit(1)).alias("posed"))
    out = seen.join(done, list(frame), "left").withColumn("posed", F.coalesce("posed", F.lit(0).cast("long")))
    return out.withColumn("skipped", F.greatest(F.col("people") - F.col("posed"), F.lit(0)))
