"""Robust baselines per recurring slot, and judging buckets against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.clock import check_period, epoch_s, slot_index
from scenelake.functions.robust import (
    MAD_TO_SIGMA,
    MIN_SLOT_SAMPLES,
    SENSITIVITY,
    SHRINKAGE_SAMPLES,
    anomaly_severity,
    floored_spread,
    level_scale,
    small_sample_correction,
)
from scenelake.operators.series import empty
from scenelake.plans.joins import join_on


def array_median(values: Column) -> Column:
    """Median of an array; 0 when it is empty. Used on slots, whose size the bucket ceiling bounds."""

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        lower = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
        upper = F.try_element_at(ordered, F.floor(n / 2).cast("int") + 1)
        return F.when(n > 0, (lower + upper) / 2).otherwise(0.0)

    # Wrapped in a one-element array so that the sorted copy is made once.
    return F.element_at(F.transform(F.array(F.array_sort(values)), middle), 1)


def slot_values(series: DataFrame, keys: Sequence[str], period_hours: int, include_empty: bool) -> DataFrame:
    """Per slot: its values, centre and sample count."""
    used = series if include_empty else series.where(~empty())
    width = F.max("width_s") if "width_s" in series.columns else F.lit(None).cast("double")
    return (
        used.groupBy(*keys, slot_index(F.col("bucket_start"), period_hours).alias("slot"))
        .agg(F.collect_list("value").alias("_values"), width.alias("width_s"))
        .withColumn("centre", array_median(F.col("_values")))
        .withColumn("samples", F.size("_values"))
        .withColumn("_off", F.transform("_values", lambda v: F.abs(v - F.col("centre"))))
    )


def _pooled(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``dispersion``: residuals of every slot that ever varied, in units of its expected scale."""
    varied = F.size(F.array_distinct("_values")) > 1
    scaled = F.transform("_off", lambda v: v / level_scale(F.col("centre")))
    carried = F.struct("slot", "centre", "samples", "width_s", "_off")
    per = slots.groupBy(*keys).agg(
        F.flatten(F.collect_list(F.when(varied, scaled))).alias("_all"),
        F.count_if(varied).alias("_n"),
        F.collect_list(carried).alias("_slots"),
    )
    each = F.greatest(F.lit(1), F.floor(F.size("_all") / F.greatest(F.col("_n"), F.lit(1))))
    per = per.withColumns({"_each": each, "_mid": array_median(F.col("_all"))})
    pooled = F.col("_mid") * MAD_TO_SIGMA * small_sample_correction(F.col("_each"))
    return per.withColumn("dispersion", F.when(F.size("_all") > 0, pooled).otherwise(0.0)).select(
        *keys, "dispersion", F.inline("_slots")
    )


def pooled_dispersion(series: DataFrame, keys: Sequence[str] = (), period_hours: int = 168, include_empty: bool = False) -> DataFrame:
    """One dispersion figure per series."""
    out = _pooled(slot_values(series, keys, period_hours, include_empty), keys)
    return out.groupBy(*keys).agg(F.first("dispersion").alias("dispersion"))


def learn_baseline(
    series: DataFrame,
    keys: Sequence[str] = (),
    *,
    period_hours: int = 168,
    sensitivity: float = SENSITIVITY,
    include_empty: bool = False,
    metric: str | None = None,
) -> DataFrame:
    """Centre, spread and band per slot, and what they were learned from: ``metric``, ``width_s`` and ``period_hours``.

    A slot's own spread is shrunk toward the series' pooled one by how many samples it has.
    One series has at most 20 000 buckets, so its slots are gathered in one group.
    """
    check_period(period_hours)
    if sensitivity <= 0:
        raise ValueError(f"sensitivity must be positive, got {sensitivity}")
    slots = _pooled(slot_values(series, keys, period_hours, include_empty), keys)
    n = F.col("samples")
    own = array_median(F.col("_off")) * MAD_TO_SIGMA * small_sample_correction(n)
    weight = n / (n + F.lit(float(SHRINKAGE_SAMPLES)))
    blended = weight * own + (1 - weight) * F.col("dispersion") * level_scale(F.col("centre"))
    out = slots.withColumn("spread", floored_spread(blended, F.col("centre")))
    return out.select(
        *keys,
        "slot",
        "centre",
        "spread",
        "samples",
        (F.col("centre") - sensitivity * F.col("spread")).alias("low"),
        (F.col("centre") + sensitivity * F.col("spread")).alias("high"),
        (n >= MIN_SLOT_SAMPLES).alias("trustworthy"),
        F.lit(metric).cast("string").alias("metric"),
        "width_s",
        F.lit(period_hours).alias("period_hours"),
    )


def same_measure(series_width: Column, metric: str | None, period_hours: int) -> Column:
    """True, or an error that fails the job, where ``_metric``, ``_width`` and ``_period`` of a baseline row do not fit the series.

    What either side does not say is not compared.
    """
    wrong = [
        (F.col("_metric") != F.lit(metric).cast("string"), F.concat(F.lit("baseline of "), F.col("_metric"), F.lit(f" cannot judge {metric}"))),
        (F.col("_width") != series_width, F.concat(F.lit("baseline of buckets of "), F.col("_width"), F.lit(" s cannot judge buckets of "), series_width, F.lit(" s"))),
        (F.col("_period") != period_hours, F.concat(F.lit("baseline of a period of "), F.col("_period"), F.lit(f" hours cannot judge one of {period_hours}"))),
    ]
    check = F.lit(True)
    for differs, message in wrong:
        check = F.when(F.coalesce(differs, F.lit(False)), F.raise_error(message).cast("boolean")).otherwise(check)
    return check


def detect(
    series: DataFrame,
    baseline: DataFrame,
    keys: Sequence[str] = (),
    *,
    period_hours: int = 168,
    sensitivity: float = SENSITIVITY,
    judge_empty: bool = False,
    metric: str | None = None,
) -> DataFrame:
    """Every bucket with its verdict: anomaly, normal, or unjudged (empty, or too little history).

    A baseline of another metric, bucket width or period fails the job.
    """
    known = baseline.select(
        *keys,
        "slot",
        F.col("centre").alias("expected"),
        "spread",
        F.col("low").alias("band_low"),
        F.col("high").alias("band_high"),
        F.col("samples").alias("slot_samples"),
        "trustworthy",
        *[F.col(c).alias(n) if c in baseline.columns else F.lit(None).cast(t).alias(n) for c, n, t in (("metric", "_metric", "string"), ("width_s", "_width", "double"), ("period_hours", "_period", "int"))],
    )
    joined = join_on(series.withColumn("slot", slot_index(F.col("bucket_start"), period_hours)), known, [*keys, "slot"], "left")
    width = F.col("width_s") if "width_s" in series.columns else F.lit(None).cast("double")
    joined = joined.where(same_measure(width, metric, period_hours)).drop("_metric", "_width", "_period")
    readable = F.lit(True) if judge_empty else ~empty()
    judged = readable & F.coalesce("trustworthy", F.lit(False))
    off = F.col("value") - F.col("expected")
    score = F.when(judged, F.when(F.col("spread") > 0, F.abs(off) / F.col("spread")).otherwise(0.0))
    out = joined.withColumn("score", score)
    verdict = F.when(~judged, "unjudged").when(F.col("score") >= sensitivity, "anomaly").otherwise("normal")
    out = out.withColumn("verdict", verdict)
    flagged = F.col("verdict") == "anomaly"
    return out.withColumns(
        {
            "direction": F.when(flagged, F.when(off > 0, "above").otherwise("below")),
            "severity": F.when(flagged, anomaly_severity(F.col("score"))),
        }
    ).drop("trustworthy")


def top_anomalies(scored: DataFrame, n: int | None = 8, keys: Sequence[str] = ()) -> DataFrame:
    """The ``n`` strongest anomalies of each series, largest score first, earlier bucket first among equals.

    ``keys`` tell series apart; without keys there is one.
    """
    flagged = scored.where(F.col("verdict") == "anomaly")
    order = [F.desc("score"), F.col("bucket_start")]
    if n is not None and keys:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        flagged = flagged.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    elif n is not None:
        return flagged.orderBy(*order).limit(n)
    return flagged.orderBy(*order, *keys)


def analysis_summary(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Buckets, judged, skipped, anomalies, above, below, coverage."""
    flagged = F.col("verdict") == "anomaly"
    skipped = F.col("verdict") == "unjudged"
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("buckets"),
        F.count_if(~skipped).alias("judged"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(flagged).alias("anomalies"),
        F.count_if(flagged & (F.col("direction") == "above")).alias("above"),
        F.count_if(flagged & (F.col("direction") == "below")).alias("below"),
        (F.count_if(~empty()) / F.count(F.lit(1))).alias("coverage"),
        F.count_distinct(F.when(F.coalesce(F.col("slot_samples"), F.lit(0)) >= MIN_SLOT_SAMPLES, F.col("slot"))).alias("slots_learned"),
    )


def detection_power(
    series: DataFrame,
    baseline: DataFrame,
    multiples: Sequence[float],
    normal: Column,
    target: Column,
    keys: Sequence[str] = (),
    *,
    period_hours: int = 168,
    sensitivity: float = SENSITIVITY,
) -> DataFrame:
    """Share of target buckets caught when raised to each multiple of their normal level."""
    raised = series.where(target).withColumn("multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    raised = raised.withColumn("value", normal * F.col("multiple")).withColumn(
        "samples", F.greatest(F.col("samples"), F.lit(1).cast("long"))
    )
    judged = detect(raised, baseline, keys, period_hours=period_hours, sensitivity=sensitivity)
    return judged.groupBy("multiple").agg(
        F.count(F.lit(1)).alias("trials"), F.avg((F.col("verdict") == "anomaly").cast("double")).alias("hit_rate")
    )


def _draw(*parts: Column) -> Column:
    """A whole number hashed from the parts, the same on every run and machine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def characterise(
    series: DataFrame, keys: Sequence[str] = (), *, trials: int = 20, training: int = 28, sizes: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), period_hours: int = 24, sensitivity: float = SENSITIVITY
) -> DataFrame:
    """How often clean data raises an alarm, and how large a rise must be to be seen: one row per series.

    Block bootstrap: each trial draws ``training`` whole periods of the series to learn from and one to judge, by hashed
    numbers. Nothing is planted in the judged one, so what it flags are false alarms; then one slot a trial is raised to each of
    ``sizes`` above its learned level. Columns: ``false_alarms_per_week``, ``worst_week`` (of any trial, as a weekly rate), ``hit_rates`` (by size),
    and ``seen_half`` and ``seen_mostly``, the smallest size caught in half and in 95 % of the trials (null: none was).
    """
    check_period(period_hours)
    if trials < 1 or training < 1 or not sizes:
        raise ValueError("characterising needs a trial, a period to learn from and a size")
    start = F.floor(epoch_s(F.col("bucket_start")) / (period_hours * 3600)).cast("long")
    blocks = series.withColumn("_block", start)
    first = blocks.groupBy(*keys).agg(F.min("_block").alias("_first"), (F.max("_block") - F.min("_block") + 1).alias("_n"))
    drawn = first.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(training))))
    drawn = drawn.select(*keys, "trial", "pos", (F.col("_first") + F.pmod(_draw(F.col("trial"), F.col("pos")), F.col("_n"))).alias("_block"))
    rows = join_on(drawn, blocks, [*keys, "_block"]).drop("_block")
    each = [*keys, "trial"]
    base = learn_baseline(rows.where("pos > 0"), each, period_hours=period_hours, sensitivity=sensitivity)
    clean = detect(rows.where("pos = 0"), base, each, period_hours=period_hours, sensitivity=sensitivity)
    alarms = clean.groupBy(*each).agg((F.count_if(F.col("verdict") == "anomaly") * (168.0 / period_hours)).alias("_alarms"))
    alarms = alarms.groupBy(*keys).agg(F.avg("_alarms").alias("false_alarms_per_week"), F.max("_alarms").alias("worst_week"))
    slot = F.pmod(_draw(F.col("trial"), F.lit("slot")), F.lit(period_hours))
    raised = base.where(F.col("slot") == slot).withColumn("size", F.explode(F.array(*[F.lit(float(x)) for x in sorted(sizes)])))
    off = F.col("centre") * F.col("size")
    caught = F.col("trustworthy") & F.coalesce(F.abs(off) / F.col("spread") >= sensitivity, F.lit(False))
    power = raised.groupBy(*keys, "size").agg(F.avg(caught.cast("double")).alias("rate"))
    power = power.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("size", "rate"))).alias("hit_rates"))
    seen = lambda share: F.array_min(F.transform(F.filter("hit_rates", lambda h: h["rate"] >= share), lambda h: h["size"]))
    out = join_on(alarms, power, keys, "left") if keys else alarms.join(power)
    return out.select(*keys, "false_alarms_per_week", "worst_week", "hit_rates", seen(0.5).alias("seen_half"), seen(0.95).alias("seen_mostly"))
