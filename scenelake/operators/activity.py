"""Activities from motion state, posture and arms: several per entity and step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.clock import us
from scenelake.operators.presence import ISLAND
from scenelake.plans.segments import HALO_US, SLICE, SLICE_US, crossing, drop_halo, hold_state, local, with_halo
from scenelake.session import settle

# Activity names, which of them describe a moment, shares of a window.
ACTIVITIES = ("idle", "walking", "running", "loitering", "sitting_down", "standing_up", "falling", "arm_raised")
TRANSIENT = ("sitting_down", "standing_up", "falling")
STABLE_POSTURES = ("standing", "sitting", "crouching", "lying")
MAJORITY = 0.6
POSTURE_MAJORITY = 0.7
WINDOW_COVERAGE = 0.9

RECOGNISERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_recognizer(name: str, recognise: Callable[[DataFrame], DataFrame]) -> None:
    """Add a recogniser: motion rows in, activity rows (columns of ``ACTIVITY_ROW``) out."""
    RECOGNISERS[name] = recognise


@dataclass(frozen=True)
class ActivitySettings:
    """Speeds in heights per second, durations in seconds."""

    walking_speed: float = 0.15
    running_speed: float = 1.30
    sustain_s: float = 0.4
    loiter_s: float = 20.0
    transition_window_s: float = 2.5
    fall_window_s: float = 1.2
    transient_hold_s: float = 1.5
    posture_window_s: float = 0.6
    min_posture_confidence: float = 0.25

    def __post_init__(self) -> None:
        if not 0 < self.walking_speed < self.running_speed:
            raise ValueError("walking_speed must be positive and below running_speed")
        times = (self.sustain_s, self.loiter_s, self.transition_window_s, self.fall_window_s, self.transient_hold_s, self.posture_window_s)
        if min(times) < 0 or self.fall_window_s > self.transition_window_s:
            raise ValueError("durations must be >= 0 and fall_window_s at most transition_window_s")
        if us(max(self.sustain_s, self.transition_window_s, self.posture_window_s)) > HALO_US:
            raise ValueError("trailing windows must be under 6 s")


ENTITY = ("entity_id", "label")
STATE_ROW = (*ISLAND, "island_t", "step", "t_us", *ENTITY, "speed", "motion", "dwell_s", "posture", "posture_confidence", "arm_raised", "arm_confidence")
ACTIVITY_ROW = (*ISLAND, "step", "t_us", *ENTITY, "activity", "confidence", "duration_s")


def _trailing(seconds: float) -> Window:
    return local(ISLAND, "t_us").rangeBetween(-us(seconds), 0)


def _windows(rows: DataFrame, s: ActivitySettings, width: int) -> DataFrame:
    """All bounded windows of the recognisers in one shuffle by (track, slice)."""
    h = with_halo(rows, "t_us", width)
    w, p, back = _trailing(s.sustain_s), _trailing(s.posture_window_s), _trailing(s.transition_window_s)

    def share(threshold: float) -> Column:
        return F.sum((F.col("speed") >= threshold).cast("int")).over(w) / F.count(F.lit(1)).over(w)

    sure = (F.col("posture") != "unknown") & (F.col("posture_confidence") >= s.min_posture_confidence)
    sure = F.coalesce(sure, F.lit(False))
    cols = {
        "_w_from": F.min("t_us").over(w),
        "_w_n": F.count(F.lit(1)).over(w),
        "_fast": share(s.running_speed * 0.8),
        "_run": share(s.running_speed),
        "_walk": share(s.walking_speed),
        "_arms": F.min(F.coalesce("arm_raised", F.lit(False)).cast("int")).over(w),
        "_arm_conf": F.avg(F.coalesce("arm_confidence", F.lit(0.0))).over(w),
        "_p_n": F.sum(sure.cast("int")).over(p),
        "_p_conf": F.avg(F.when(sure, F.col("posture_confidence"))).over(p),
    }
    for name in STABLE_POSTURES:
        cols[f"_n_{name}"] = F.sum((sure & (F.col("posture") == name)).cast("int")).over(p)
        cols[f"_seen_{name}"] = F.max(F.when(F.col("posture") == name, F.col("t_us"))).over(back)
    return drop_halo(h.withColumns(cols))


def _sustained(s: ActivitySettings) -> Column:
    """Enough history: two samples at least, spanning nearly the whole window."""
    return (F.col("_w_n") >= 2) & (F.col("t_us") - F.col("_w_from") >= us(s.sustain_s * WINDOW_COVERAGE))


def _found(name: str | Column, confidence: Column, duration_s: Column) -> Column:
    label = F.lit(name) if isinstance(name, str) else name
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    return F.struct(label.alias("activity"), bounded.alias("confidence"), duration_s.alias("duration_s"))


def _locomotion(s: ActivitySettings) -> Column:
    speed = F.col("speed")
    running = (speed >= s.running_speed) & (F.col("_fast") >= MAJORITY)
    threshold = F.when(running, s.running_speed).otherwise(s.walking_speed)
    support = F.when(running, F.col("_run")).otherwise(F.col("_walk"))
    going = (F.col("motion") == "moving") & (speed >= s.walking_speed) & _sustained(s) & (support >= MAJORITY)
    pace = F.least(F.lit(1.0), F.abs(speed - threshold) / threshold)
    return F.when(going, _found(F.when(running, "running").otherwise("walking"), 0.5 * pace + 0.5 * support, F.col("dwell_s")))


def _loitering(s: ActivitySettings) -> Column:
    long = (F.col("motion") == "stationary") & (F.col("dwell_s") >= s.loiter_s)
    excess = (F.col("dwell_s") - s.loiter_s) / max(s.loiter_s, 1e-6)
    return F.when(long, _found("loitering", 0.5 + 0.5 * excess, F.col("dwell_s")))


def _arm_held(s: ActivitySettings) -> Column:
    up = _sustained(s) & (F.col("_arms") == 1)
    return F.when(up, _found("arm_raised", F.col("_arm_conf"), (F.col("t_us") - F.col("_w_from")) / 1e6))


def _rows_of(rows: DataFrame, found: Column) -> DataFrame:
    out = rows.withColumn("_a", found).where(F.col("_a").isNotNull())
    return out.select(*ISLAND, "step", "t_us", *ENTITY, "_a.*").select(*ACTIVITY_ROW)


def locomotion(state: DataFrame, settings: ActivitySettings = ActivitySettings(), *, width: int = SLICE_US) -> DataFrame:
    """Walking or running, sustained."""
    return _rows_of(_windows(with_pose_columns(state), settings, width), _locomotion(settings))


def loitering(state: DataFrame, settings: ActivitySettings = ActivitySettings()) -> DataFrame:
    """Stationary for at least ``loiter_s``."""
    return _rows_of(state, _loitering(settings))


def arm_held(state: DataFrame, settings: ActivitySettings = ActivitySettings(), *, width: int = SLICE_US) -> DataFrame:
    """An arm raised on every sample of the window."""
    return _rows_of(_windows(with_pose_columns(state), settings, width), _arm_held(settings))


def with_pose_columns(state: DataFrame) -> DataFrame:
    """Fills in posture and arm columns a deployment without pose does not have."""
    defaults = {
        "posture": F.lit("unknown"),
        "posture_confidence": F.lit(0.0),
        "arm_raised": F.lit(False),
        "arm_confidence": F.lit(0.0),
    }
    return state.withColumns({c: v for c, v in defaults.items() if c not in state.columns})


def stable_posture(state: DataFrame, settings: ActivitySettings = ActivitySettings(), *, width: int = SLICE_US) -> DataFrame:
    """Adds ``stable``, the posture a clear majority of the last window showed, kept until another does."""
    among = crossing(state, ISLAND, "t_us", "island_t", width)
    rows = _windows(with_pose_columns(state), settings, width)
    leader = F.when(F.lit(False), F.lit(0))
    for code, name in enumerate(STABLE_POSTURES):
        leader = leader.when((F.col("_p_n") > 0) & (F.col(f"_n_{name}") >= F.col("_p_n") * POSTURE_MAJORITY), code)
    out = hold_state(rows, ISLAND, "t_us", leader, state="_stable", since="stable_t", previous="_was", width=width, among=among)

    def named(code: str) -> Column:
        return F.get(F.array(*[F.lit(n) for n in STABLE_POSTURES]), F.col(code))

    return out.withColumns({"stable": named("_stable"), "was": named("_was")}).drop("_stable", "_was")


def posture_transitions(stable: DataFrame, settings: ActivitySettings = ActivitySettings()) -> DataFrame:
    """sitting_down, standing_up and falling, timed from the last sample that showed the old posture.

    A change from upright to lying slower than a fall is reported as nothing.
    """
    s = settings
    seen = F.when(F.lit(False), F.lit(0).cast("long"))
    for name in STABLE_POSTURES:
        seen = seen.when(F.col("was") == name, F.col(f"_seen_{name}"))
    changed = (F.col("stable_t") == F.col("t_us")) & F.col("was").isNotNull() & (F.col("was") != F.col("stable"))
    gap = F.col("t_us") - seen
    name = (
        F.when((F.col("stable") == "lying") & F.col("was").isin("standing", "crouching"), F.when(gap <= us(s.fall_window_s), "falling"))
        .when((F.col("was") == "standing") & (F.col("stable") == "sitting"), "sitting_down")
        .when((F.col("was") == "sitting") & (F.col("stable") == "standing"), "standing_up")
    )
    out = stable.withColumns({"activity": name, "gap_s": gap / 1e6})
    out = out.where(changed & (gap <= us(s.transition_window_s)) & F.col("activity").isNotNull())
    return out.select(*ISLAND, "step", "t_us", "activity", F.least(F.lit(1.0), F.col("_p_conf")).alias("confidence"), "gap_s")


def _held_moments(rows: DataFrame, moments: DataFrame, s: ActivitySettings) -> DataFrame:
    """(row, moment) pairs at most ``transient_hold_s`` apart: an equi-join on the hold's time beat."""
    hold = us(s.transient_hold_s)
    beat = F.floor(F.col("t_us") / F.lit(max(hold, 1))).cast("long")
    events = moments.select(
        *ISLAND, "activity", "confidence", F.col("t_us").alias("_at"), F.explode(F.array(beat, beat + 1)).alias("_beat")
    )
    joined = rows.withColumn("_beat", beat).join(events, [*ISLAND, "_beat"])
    return joined.where((F.col("t_us") >= F.col("_at")) & (F.col("t_us") - F.col("_at") <= hold)).drop("_beat")


def hold_transients(rows: DataFrame, moments: DataFrame, settings: ActivitySettings = ActivitySettings()) -> DataFrame:
    """A moment keeps being reported for ``transient_hold_s``."""
    out = _held_moments(rows.select(*ISLAND, "step", "t_us", *ENTITY), moments, settings)
    return out.withColumn("duration_s", (F.col("t_us") - F.col("_at")) / 1e6).select(*ACTIVITY_ROW)


def activities_union(*parts: DataFrame) -> DataFrame:
    """All recognisers' rows together."""
    out = parts[0].select(*ACTIVITY_ROW)
    for part in parts[1:]:
        out = out.unionByName(part.select(*ACTIVITY_ROW))
    return out


def idle_fill(rows: DataFrame, activities: DataFrame) -> DataFrame:
    """An ``idle`` row wherever an entity has no activity at all."""
    on = [*ISLAND, "step"]
    alone = rows.join(activities.select(*on), on, "left_anti")
    idle = alone.select(
        *ISLAND, "step", "t_us", *ENTITY, F.lit("idle").alias("activity"), F.lit(1.0).alias("confidence"),
        ((F.col("t_us") - F.col("island_t")) / 1e6).alias("duration_s"),
    )
    return activities_union(activities, idle)


def activities(state: DataFrame, settings: ActivitySettings = ActivitySettings(), *, width: int = SLICE_US) -> DataFrame:
    """Everything every entity is doing on every step, in one plan.

    The continuous activities ride along on the rows of the posture pass, which is written once, as it is read
    three times; only the rare posture changes are joined back. A row left with nothing is idle.
    """
    s = settings
    read = settle(with_pose_columns(state).select(*STATE_ROW))
    rows = settle(stable_posture(read, s, width=width))
    moments = posture_transitions(rows, s)
    held = (
        _held_moments(rows.select(*ISLAND, "t_us"), moments, s)
        .groupBy(*ISLAND, "t_us")
        .agg(F.collect_list(_found(F.col("activity"), F.col("confidence"), (F.col("t_us") - F.col("_at")) / 1e6)).alias("_moments"))
    )
    full = rows.join(held, [*ISLAND, "t_us"], "left")
    found = F.array_compact(F.array(_locomotion(s), _loitering(s), _arm_held(s)))
    found = F.concat(found, F.coalesce(F.col("_moments"), F.array().cast(held.schema["_moments"].dataType)))
    idle = F.array(_found("idle", F.lit(1.0), (F.col("t_us") - F.col("island_t")) / 1e6))
    full = full.withColumn("_found", found).withColumn("_found", F.when(F.size("_found") > 0, F.col("_found")).otherwise(idle))
    out = full.select(*ISLAND, "step", "t_us", *ENTITY, F.inline("_found")).select(*ACTIVITY_ROW)
    for recognise in RECOGNISERS.values():
        out = out.unionByName(recognise(state).select(*ACTIVITY_ROW))
    return out


def primary_activity(activities: DataFrame) -> DataFrame:
    """The one activity most worth showing per entity and step."""
    rank = F.struct(
        F.col("activity").isin(*TRANSIENT).alias("a"), (F.col("activity") != "idle").alias("b"), F.col("confidence").alias("c"), F.col("activity").alias("d")
    )
    best = activities.groupBy("source_id", "track_id", "step", "t_us").agg(
        F.max_by(F.struct("activity", "confidence", "duration_s"), rank).alias("_best")
    )
    return best.select("source_id", "track_id", "step", "t_us", "_best.*")


def notable(activities: DataFrame) -> DataFrame:
    """Rows of doing something other than being there."""
    return activities.where(F.col("activity") != "idle")


def rising_edges(activities: DataFrame, *, width: int = SLICE_US) -> DataFrame:
    """First row of each unbroken stretch of one activity; same-step duplicates count once."""
    keys = [*ISLAND, "activity"]
    once = activities.groupBy(*keys, "step", "t_us").agg(F.max("confidence").alias("confidence"))
    h = with_halo(once, "t_us", width)
    before = F.lag("step").over(local(keys, "t_us"))
    return drop_halo(h.withColumn("_before", before)).where(~F.col("_before").eqNullSafe(F.col("step") - 1)).drop("_before", SLICE)
