"""Motion state with hysteresis, dwell, distance and bearing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.boxes import bearing_deg, box_center_x, box_center_y, box_height, speed_heights
from scenelake.functions.clock import us
from scenelake.operators.presence import ISLAND
from scenelake.plans.segments import HALO_US, SLICE, SLICE_US, carry, crossing, drop_halo, hold_state, local, with_halo
from scenelake.session import settle


@dataclass(frozen=True)
class MotionSettings:
    """Thresholds in heights per second, holds in seconds."""

    moving_above: float = 0.15
    stationary_below: float = 0.08
    min_state_s: float = 0.5
    min_age_s: float = 0.3

    def __post_init__(self) -> None:
        if self.stationary_below > self.moving_above:
            raise ValueError("stationary_below must not exceed moving_above")
        if min(self.moving_above, self.stationary_below, self.min_state_s, self.min_age_s) < 0:
            raise ValueError("motion settings must be >= 0")


def motion_state(
    tracks: DataFrame, settings: MotionSettings = MotionSettings(), *, width: int = SLICE_US, with_distance: bool = True
) -> DataFrame:
    """Adds motion, speed, dwell_s, age_s, distance and bearing_deg to tracks with presence islands.

    A run of fast (or slow) steps takes the state over once it has lasted ``min_state_s``; a
    step between the thresholds ends the run. So the state is the kind of the latest run that
    lasted long enough, which windows express without walking the rows one by one.
    """
    s = settings
    if us(s.min_state_s) > HALO_US - us(2.0):
        raise ValueError("min_state_s must be under 4 s")
    keys = list(ISLAND)
    speed = speed_heights(F.col("vx"), F.col("vy"), box_height(F.col("box")))
    age = F.col("t_us") - F.col("island_t") + F.col("island_e")
    base = tracks.withColumns({"speed": speed, "_age": age})
    kind = F.when(F.col("_age") >= us(s.min_age_s), F.when(F.col("speed") >= s.moving_above, 1).when(F.col("speed") <= s.stationary_below, 2))
    among = crossing(tracks, keys, "t_us", "island_t", width)
    h = with_halo(base.withColumn("_kind", F.coalesce(kind, F.lit(0))), "t_us", width)
    w = local(keys, "t_us")
    height = F.greatest(box_height(F.col("box")), F.lit(1.0))
    cx, cy = box_center_x(F.col("box")), box_center_y(F.col("box"))
    moved = F.coalesce(F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)) / height, F.lit(0.0))
    h = h.withColumns({"_run": F.when(~F.lag("_kind").over(w).eqNullSafe(F.col("_kind")), F.col("t_us")), "_moved": moved})
    h = h.withColumn("_run", F.last("_run", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = (F.col("_kind") > 0) & (F.col("t_us") - F.col("_run") >= us(s.min_state_s))
    out = hold_state(drop_halo(h), keys, "t_us", F.when(held, F.col("_kind")), state="_state", since="_since", width=width, among=among)
    out = out.withColumns(
        {
            "motion": F.when(F.col("_state") == 1, "moving").when(F.col("_state") == 2, "stationary").otherwise("unknown"),
            "dwell_s": F.coalesce(F.col("t_us") - F.col("_since"), F.col("_age")) / 1e6,
            "age_s": F.col("_age") / 1e6,
        }
    )
    going = F.col("motion") == "moving"
    out = out.withColumn("bearing_deg", bearing_deg(F.col("vx"), F.col("vy"), going)).drop("_kind", "_run", "_state", "_since", "_age")
    if with_distance:
        out = carry(settle(out), keys, ["t_us"], sums={"distance": F.when(going, F.col("_moved")).otherwise(0.0)}, width=width, among=among)
    return out.drop("_moved", SLICE)
