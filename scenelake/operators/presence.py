"""Footage time and presence.

Temporal operators work on rows keyed ``(source_id, track_id)`` with ``step`` (dense frame
ordinal of the source), ``t_us`` (footage time) and ``elapsed_us`` (length of the step).
All memory of an entity ends with the first step it is absent, so they partition by
``island``: the step at which the current unbroken presence began.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.functions.clock import to_us
from scenelake.plans.segments import HALO_US, SLICE, SLICE_US, carry, drop_halo, local, with_halo
from scenelake.session import settle

NOMINAL_STEP_S = 1.0 / 30.0
MAX_STEP_S = 2.0
FRAMES_PER_SLICE = 100_000
TRACK = ("source_id", "track_id")
ISLAND = (*TRACK, "island")


def elapsed(frames: DataFrame, clock: str = "capture_s", max_step_s: float = MAX_STEP_S) -> DataFrame:
    """``elapsed_s`` since the previous frame of the source.

    The first step, and one whose clock did not advance, count as 1/30 s; a stall is clamped.
    """
    out = carry(frames, ["source_id"], ["frame_index"], befores={"_prev": F.col(clock)}, width=FRAMES_PER_SLICE)
    dt = F.col(clock) - F.col("_prev")
    step = F.when(dt.isNull() | (dt <= 0), F.lit(NOMINAL_STEP_S)).when(dt > max_step_s, F.lit(max_step_s)).otherwise(dt)
    return out.withColumn("elapsed_s", step).drop("_prev", SLICE)


def footage_time(frames: DataFrame, max_step_s: float = MAX_STEP_S, width: int = FRAMES_PER_SLICE) -> DataFrame:
    """Adds ``step``, ``elapsed_us`` and the running ``t_us`` to one row per frame.

    Summed as whole microseconds, so the result does not depend on the order of addition.
    """
    length = to_us(F.least(F.greatest("elapsed_s", F.lit(0.0)), F.lit(max_step_s)))
    out = carry(
        frames.withColumn("elapsed_us", length),
        ["source_id"],
        ["frame_index"],
        sums={"step": F.lit(1).cast("long"), "t_us": F.col("elapsed_us")},
        width=width,
    )
    return out.withColumn("step", F.col("step") - 1).drop(SLICE)


def on_footage_time(entities: DataFrame, frames: DataFrame) -> DataFrame:
    """Entity rows with the clock columns of their frame."""
    clock = frames.select("source_id", "frame_index", "step", "elapsed_us", "t_us")
    return entities.join(clock, ["source_id", "frame_index"])


def step_ordinal(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "step", width: int = FRAMES_PER_SLICE) -> DataFrame:
    """Dense 0-based ordinal of each row along ``order`` within its key."""
    out = carry(rows, keys, order, sums={name: F.lit(1).cast("long")}, width=width)
    return out.withColumn(name, F.col(name) - 1).drop(SLICE)


def presence_islands(tracks: DataFrame, keys: Sequence[str] = TRACK, width: int = SLICE_US, halo: int = HALO_US) -> DataFrame:
    """Adds ``island``, ``island_t``, ``island_e`` (start step, time and first step length),
    and ``prev_t``/``next_t``, the times of the neighbouring steps of the same island.

    The result is written once, because every temporal operator reads it more than once.
    """
    h = with_halo(tracks, "t_us", width, halo, halo)
    w = local(keys, "t_us")
    before, after = F.lag("step").over(w), F.lead("step").over(w)
    h = h.withColumns(
        {
            "prev_t": F.when(before == F.col("step") - 1, F.lag("t_us").over(w)),
            "next_t": F.when(after == F.col("step") + 1, F.lead("t_us").over(w)),
        }
    )
    starts = F.col("prev_t").isNull()
    out = carry(
        drop_halo(h),
        keys,
        ["t_us"],
        lasts={
            "island": F.when(starts, F.col("step")),
            "island_t": F.when(starts, F.col("t_us")),
            "island_e": F.when(starts, F.col("elapsed_us")),
        },
        width=width,
    )
    return settle(out.drop(SLICE))
