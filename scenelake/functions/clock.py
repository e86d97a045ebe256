"""Time expressions. Wall time is a timestamp, footage time a long of microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOURS_PER_WEEK = 168
HOURS_PER_DAY = 24

_UNITS = {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}


def duration_s(text: str) -> float:
    """``30m``, ``6h``, ``7d``, ``4w`` or a bare number of seconds."""
    text = text.strip().lower()
    unit = text[-1:] if text[-1:] in _UNITS else ""
    try:
        value = float(text[: len(text) - len(unit)])
    except ValueError:
        raise ValueError(f"not a duration: {text!r}; use a number with one of {sorted(_UNITS)}") from None
    if value < 0:
        raise ValueError(f"a duration cannot be negative: {text!r}")
    return value * _UNITS.get(unit, 1.0)


def epoch_s(ts: Column) -> Column:
    """Seconds since the epoch with the fraction kept."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def to_us(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("long")


def us(seconds: float) -> int:
    return round(seconds * 1_000_000)


def check_period(period_hours: int) -> None:
    if period_hours not in (HOURS_PER_DAY, HOURS_PER_WEEK):
        raise ValueError(f"a baseline period is 24 or 168 hours, not {period_hours}")


def slot_index(ts: Column, period_hours: int = HOURS_PER_WEEK) -> Column:
    """Hour of the week (Monday 00:00 = 0) or of the day, in the session time zone."""
    check_period(period_hours)
    hour = F.hour(ts)
    return hour if period_hours == HOURS_PER_DAY else F.weekday(ts) * 24 + hour


def bucket_index(epoch: Column, origin_s: float, width_s: float) -> Column:
    """Floor, so times left of the origin get negative buckets."""
    return F.floor((epoch - F.lit(float(origin_s))) / F.lit(float(width_s))).cast("long")


def local_midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def next_local_midnight(ts: Column) -> Column:
    """Midnight strictly after, by the calendar rather than by adding 86 400 s."""
    return F.date_add(F.to_date(ts), 1).cast("timestamp")
