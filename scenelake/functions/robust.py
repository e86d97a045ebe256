"""Scalar pieces of the robust baseline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor by which the deviation of n samples is too small.
SMALL_SAMPLE = {2: 2.20, 3: 1.85, 4: 1.49, 5: 1.34, 6: 1.26, 8: 1.17, 12: 1.12, 16: 1.10, 26: 1.05}
MAD_TO_SIGMA = 1.4826
SHRINKAGE_SAMPLES = 8
RELATIVE_FLOOR = 0.02
ABSOLUTE_FLOOR = 0.75
MIN_SLOT_SAMPLES = 3
SENSITIVITY = 3.5


def small_sample_correction(n: Column) -> Column:
    """Table value, straight line between its points, ``1 + 1.3/n`` beyond its end."""
    sizes = sorted(SMALL_SAMPLE)
    out = F.when(n <= sizes[0], F.lit(SMALL_SAMPLE[sizes[0]]))
    for lo, hi in zip(sizes, sizes[1:]):
        weight = (n - lo) / F.lit(float(hi - lo))
        out = out.when(n <= hi, SMALL_SAMPLE[lo] * (1 - weight) + SMALL_SAMPLE[hi] * weight)
    return out.otherwise(1.0 + 1.3 / n)


def level_scale(centre: Column) -> Column:
    """Expected variation at a level: counts vary as the root of what is counted."""
    return F.sqrt(F.abs(centre) + 1.0)


def floored_spread(spread: Column, centre: Column) -> Column:
    return F.greatest(spread, F.abs(centre) * RELATIVE_FLOOR, F.lit(ABSOLUTE_FLOOR))


def anomaly_severity(score: Column) -> Column:
    return F.when(score >= 8.0, "high").when(score >= 5.0, "medium").otherwise("low")


def median(value: Column) -> Column:
    """Exact; the mean of the two middle values for an even count."""
    return F.percentile(value, F.lit(0.5))
