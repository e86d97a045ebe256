"""Was a window unusual? Bucket, mark zeros, learn, judge: one plan over all cameras."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.clock import check_period
from scenelake.functions.robust import SENSITIVITY
from scenelake.operators.baseline import detect, learn_baseline
from scenelake.operators.series import HOUR, WEEK, bucket_parts, grid_for, mark_alive, mark_observed_zeros, metric_named, restricted


@dataclass(frozen=True)
class AnalysisSettings:
    """How to bucket, how far back to learn, how sure to be."""

    interval_s: float = HOUR
    period_hours: int = 168
    sensitivity: float = SENSITIVITY
    training_span_s: float = 4 * WEEK
    judge_empty: bool = False
    include_empty_in_training: bool = False
    infer_zeros: bool = True
    zero_reach: int = 2

    def __post_init__(self) -> None:
        check_period(self.period_hours)
        if self.interval_s <= 0 or self.sensitivity <= 0 or self.training_span_s < 0 or self.zero_reach < 1:
            raise ValueError("interval and sensitivity must be positive, the span >= 0, the reach >= 1")
        if self.include_empty_in_training and not self.infer_zeros:
            raise ValueError("training on empty buckets without inferring zeros would learn an outage as normal")


def analyse(
    df: DataFrame,
    metric: str = "entities",
    *,
    since: float,
    until: float,
    keys: Sequence[str] = (),
    settings: AnalysisSettings | None = None,
    heartbeats: DataFrame | None = None,
    camera: str | None = None,
    entity_type: str | None = None,
    zone: str | None = None,
    train_on_window: bool = False,
) -> DataFrame:
    """Judge every bucket of ``[since, until)`` against the history before it.

    History and window are bucketed in the same scan, so a camera that fell silent still
    has its buckets. Filters apply to both parts.
    """
    s = settings or AnalysisSettings()
    m = metric_named(metric)
    window = grid_for(df, since, until, s.interval_s)
    parts = [("window", window)]
    if not train_on_window:
        if s.training_span_s <= 0:
            raise ValueError("learning from history needs a training span greater than zero")
        parts.insert(0, ("training", grid_for(df, since - s.training_span_s, since, s.interval_s)))
    beats = heartbeats
    if beats is not None and camera is not None:
        beats = beats.where(F.col("camera_id") == camera)
    calendar = None
    if s.infer_zeros and beats is not None and list(keys) == ["camera_id"]:
        calendar = beats.where(reduce(or_, [grid.holds(F.col("timestamp")) for _, grid in parts]))
    series = bucket_parts(restricted(df, m, camera, entity_type, zone), m, parts, keys, calendar)
    if s.infer_zeros:
        if beats is not None:
            halves = [mark_alive(series.where(F.col("part") == name), beats, grid, keys) for name, grid in parts]
            series = halves[0] if len(halves) == 1 else halves[0].unionByName(halves[1])
        series = mark_observed_zeros(series, keys, s.zero_reach)
    learn_from = series if train_on_window else series.where(F.col("part") == "training")
    baseline = learn_baseline(
        learn_from, keys, period_hours=s.period_hours, sensitivity=s.sensitivity, include_empty=s.include_empty_in_training, metric=metric
    )
    judged = series.where(F.col("part") == "window").drop("part")
    return detect(judged, baseline, keys, period_hours=s.period_hours, sensitivity=s.sensitivity, judge_empty=s.judge_empty, metric=metric)
