"""Table-valued reports over series and scored buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.baseline import analysis_summary, top_anomalies
from scenelake.operators.series import metric_named, series_stats
from scenelake.plans.bounds import MAX_PAYLOAD_BUCKETS

FEW_BUCKETS = 6
PAYLOAD_ANOMALIES = 50


def coverage_warning(coverage: Column) -> Column:
    """``low`` under 25 %, ``partial`` under 70 %, else null."""
    return F.when(coverage < 0.25, "low").when(coverage < 0.7, "partial")


def series_report(series: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: total (null for averages), typical, busiest, quietest, and how far to trust it."""
    s = series_stats(series, keys, metric)
    few = F.col("occupied") < FEW_BUCKETS
    silent = F.col("occupied") == 0
    shown = ~few & ~silent
    return s.select(
        *keys,
        F.lit(metric).alias("metric"),
        "buckets",
        "occupied",
        "coverage",
        F.when(~silent, F.col("total")).alias("total"),
        F.when(~silent, F.col("mean")).alias("typical"),
        F.when(shown, F.col("peak_value")).alias("busiest"),
        F.when(shown, F.col("peak_start")).alias("busiest_start"),
        F.when(shown & (F.col("quiet_start") != F.col("peak_start")), F.col("quiet_value")).alias("quietest"),
        F.when(shown & (F.col("quiet_start") != F.col("peak_start")), F.col("quiet_start")).alias("quietest_start"),
        silent.alias("nothing_recorded"),
        (few & ~silent).alias("too_few"),
        F.when(~silent, coverage_warning(F.col("coverage"))).alias("coverage_warning"),
    )


def analysis_report(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What the baseline made of a window, with the caveats a reader needs."""
    s = analysis_summary(scored, keys)
    return s.withColumns(
        {
            "nothing_judged": F.col("judged") <= 0,
            "mostly_unjudged": (F.col("judged") > 0) & (F.col("skipped") / F.greatest(F.col("buckets"), F.lit(1)) > 0.5),
            "maybe_camera_fault": F.col("below") > 0,
            "coverage_warning": coverage_warning(F.col("coverage")),
        }
    )


def check_payload(since: float, until: float, interval_s: float, metric: str) -> None:
    """Refuse a chart of too many buckets before any plan is made."""
    metric_named(metric)
    if until <= since or interval_s <= 0:
        raise ValueError("since and interval must be positive durations")
    if (until - since) / interval_s > MAX_PAYLOAD_BUCKETS:
        raise ValueError(f"that window would hold more than {MAX_PAYLOAD_BUCKETS} buckets")


def chart_buckets(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Buckets as charted."""
    return series.select(*keys, "bucket_start", F.round("value", 4).alias("value"), "samples", "known_zero")


def chart_anomalies(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The 50 strongest anomalies as listed beside the chart."""
    return top_anomalies(scored, PAYLOAD_ANOMALIES).select(
        *keys, "bucket_start", F.round("value", 3).alias("observed"), F.round("expected", 3).alias("expected"), "direction", F.round("score", 2).alias("score"), "severity"
    )
