"""Size checks: what may be broadcast, and how wide a calendar may get."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
MAX_BUCKETS = 20_000
MAX_PAYLOAD_BUCKETS = 2_000


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no more than one row past that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side keeps its shuffle join."""
    return F.broadcast(df) if fits(df, rows) else df


def bucket_span(since_s: float, until_s: float, origin_s: float, width_s: float, ceiling: int = MAX_BUCKETS) -> tuple[int, int]:
    """First and last bucket index of a window snapped outward to whole buckets.

    ``until`` is exclusive, so the last bucket is the one holding the instant before it.
    """
    if width_s <= 0:
        raise ValueError(f"bucket width must be positive, got {width_s}")
    if until_s <= since_s:
        raise ValueError(f"window is empty or inverted: since={since_s} until={until_s}")
    first = math.floor((since_s - origin_s) / width_s)
    last = max(first, math.floor((until_s - 1e-6 - origin_s) / width_s))
    if last - first + 1 > ceiling:
        raise ValueError(f"{last - first + 1} buckets asked for, the ceiling is {ceiling}: widen the interval")
    return first, last
