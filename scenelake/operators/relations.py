"""Pairwise relations: near, approaching, receding, interacting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.boxes import box_area, ground_distance
from scenelake.functions.clock import us
from scenelake.functions.keypoints import wrist_inside
from scenelake.plans.segments import HALO_US, SLICE, SLICE_US, carry, drop_halo, hold_state, local, with_halo
from scenelake.session import settle

PAIR = ("source_id", "low", "high")
PAIR_ISLAND = (*PAIR, "pair_island")


@dataclass(frozen=True)
class RelationSettings:
    """Distances in heights, rates in heights per second."""

    near_distance: float = 1.5
    near_hysteresis: float = 0.3
    approach_rate: float = 0.25
    approach_window_s: float = 0.8
    interact_distance: float = 0.6
    interact_s: float = 1.0
    reach_confidence: float = 0.35
    max_entities: int = 24

    def __post_init__(self) -> None:
        values = (self.near_distance, self.near_hysteresis, self.approach_rate, self.approach_window_s, self.interact_distance, self.interact_s)
        if min(values) < 0:
            raise ValueError("relation settings must be >= 0")
        if self.interact_distance > self.near_distance:
            raise ValueError("interact_distance must not exceed near_distance")
        if not 0.0 <= self.reach_confidence <= 1.0 or self.max_entities < 2:
            raise ValueError("reach_confidence must be in [0, 1], max_entities at least 2")


def largest_per_frame(tracks: DataFrame, k: int, by: tuple[str, ...] = ("source_id", "step")) -> DataFrame:
    """The k largest boxes of each frame, lower track id first among equals.

    The rank limit is applied before the shuffle too, so a crowded frame sends k rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(box_area(F.col("box")).desc(), "track_id"))
    return tracks.withColumn("size_rank", rank).where(F.col("size_rank") <= k)


def pair_join(tracks: DataFrame, max_entities: int = 24) -> DataFrame:
    """All unordered pairs of the ``max_entities`` largest boxes of each frame.

    ``first`` has the lower track id. At most 24 entities meet in a frame, so a frame's list is bounded.
    """
    present = [c for c in ("entity_id", "label", "motion", "keypoints") if c in tracks.columns]
    one = F.struct("track_id", "box", *present)
    frames = (
        largest_per_frame(tracks, max_entities)
        .groupBy("source_id", "step", "t_us")
        .agg(F.array_sort(F.collect_list(one)).alias("_all"))
    )
    firsts = frames.select("source_id", "step", "t_us", "_all", F.posexplode("_all").alias("_i", "first"))
    later = F.slice("_all", F.col("_i") + 2, F.greatest(F.size("_all") - F.col("_i") - 1, F.lit(0)))
    pairs = firsts.select("source_id", "step", "t_us", "first", F.explode(later).alias("second"))
    return pairs.withColumns(
        {"low": F.col("first.track_id"), "high": F.col("second.track_id"), "separation": ground_distance(F.col("first.box"), F.col("second.box"))}
    )


def pair_history(tracks: DataFrame, settings: RelationSettings = RelationSettings(), *, width: int = SLICE_US) -> DataFrame:
    """Pairs with ``pair_island``: a pair's memory ends when either side is not among the considered."""
    h = with_halo(pair_join(tracks, settings.max_entities), "t_us", width)
    w = local(PAIR, "t_us")
    starts = ~F.coalesce(F.lag("step").over(w) == F.col("step") - 1, F.lit(False))
    h = h.withColumn("_start", F.when(starts, F.col("step")))
    out = carry(drop_halo(h), PAIR, ["t_us"], lasts={"pair_island": F.col("_start")}, width=width)
    return settle(out.drop(SLICE, "_start"))


def _edge(df: DataFrame, relation, subject: str, target: str, confidence, duration_us) -> DataFrame:
    return df.select(
        *PAIR_ISLAND,
        "step",
        "t_us",
        (F.lit(relation) if isinstance(relation, str) else relation).alias("relation"),
        F.col(f"{subject}.entity_id").alias("subject_id"),
        F.col(f"{target}.entity_id").alias("object_id"),
        F.col(f"{subject}.track_id").alias("subject_track"),
        F.col(f"{target}.track_id").alias("object_track"),
        F.col("separation").alias("distance"),
        confidence.alias("confidence"),
        (duration_us / 1e6).alias("duration_s"),
    )


def near_relation(pairs: DataFrame, settings: RelationSettings = RelationSettings(), *, width: int = SLICE_US) -> DataFrame:
    """Near from ``near_distance`` on, until farther than that plus the hysteresis."""
    s, sep = settings, F.col("separation")
    marker = F.when(sep <= s.near_distance, 1).when(sep > s.near_distance + s.near_hysteresis, 0)
    out = hold_state(pairs, PAIR_ISLAND, "t_us", marker, state="_near", since="_since", width=width)
    out = out.where(F.col("_near") == 1)
    margin = 1.0 - F.least(F.lit(1.0), sep / max(s.near_distance, 1e-6))
    return _edge(out, "near", "first", "second", F.greatest(F.lit(0.15), margin), F.col("t_us") - F.col("_since"))


def closing_rate(pairs: DataFrame, settings: RelationSettings = RelationSettings(), *, width: int = SLICE_US) -> DataFrame:
    """Approaching or receding, from the first and last separation of the trailing window."""
    s, span_us = settings, us(settings.approach_window_s)
    if span_us > HALO_US:
        raise ValueError("approach_window_s must be under 6 s")
    h = with_halo(pairs, "t_us", width)
    w = local(PAIR_ISLAND, "t_us").rangeBetween(-span_us, 0)
    h = h.withColumns({"_t0": F.first("t_us").over(w), "_d0": F.first("separation").over(w)})
    span = F.col("t_us") - F.col("_t0")
    rate = (F.col("_d0") - F.col("separation")) / (span / 1e6)
    out = drop_halo(h.withColumn("_rate", F.when((span > 0) & (span >= span_us * 0.5), rate)))
    out = out.where(F.abs("_rate") >= s.approach_rate)
    relation = F.when(F.col("_rate") > 0, "approaching").otherwise("receding")
    return _edge(out, relation, "first", "second", F.least(F.lit(1.0), F.abs("_rate") / (s.approach_rate * 3.0)), F.lit(span_us))


def person_object_pairs(pairs: DataFrame, event_time: str | None = None) -> DataFrame:
    """Pairs with exactly one side labelled person; that side becomes ``person``.

    On a stream ``event_time`` names the column of its watermark. The choice then refers to it, as Spark would else make it
    before the watermark, which pairs of two persons or two things would no longer move on.
    """
    a, b = F.lower("first.label") == "person", F.lower("second.label") == "person"
    mixed = pairs.where(F.when(a != b, F.col(event_time)).isNotNull() if event_time else a != b)
    return mixed.withColumns(
        {"person": F.when(a, F.col("first")).otherwise(F.col("second")), "thing": F.when(a, F.col("second")).otherwise(F.col("first"))}
    )


def interaction(pairs: DataFrame, settings: RelationSettings = RelationSettings(), *, width: int = SLICE_US) -> DataFrame:
    """A person reaching for, or stopped beside, an object for at least ``interact_s``.

    Needs ``motion`` on the tracks, and ``keypoints`` for reaches; without them nothing is claimed.
    """
    s = settings
    both = person_object_pairs(pairs)
    fields = both.schema["person"].dataType.fieldNames()
    reach = wrist_inside(F.col("person.keypoints"), F.col("thing.box"), s.reach_confidence) if "keypoints" in fields else F.lit(False)
    stopped = F.coalesce(F.col("person.motion") == "stationary", F.lit(False)) if "motion" in fields else F.lit(False)
    both = both.withColumn("_reach", F.coalesce(reach, F.lit(False)))
    close = F.col("_reach") | (stopped & (F.col("separation") <= s.interact_distance))
    out = hold_state(
        both,
        PAIR_ISLAND,
        "t_us",
        close.cast("int"),
        state="_close",
        since="_since",
        lasts={"_reached": F.when(F.col("_reach"), F.col("t_us"))},
        width=width,
    )
    held = F.col("t_us") - F.col("_since")
    out = out.where((F.col("_close") == 1) & (held >= us(s.interact_s)))
    stretch = [*PAIR_ISLAND, "_since"]
    # The claim starts at the first step of the stretch that is held long enough.
    out = carry(out, stretch, ["t_us"], befores={"_before": F.col("t_us")}, width=width)
    out = carry(out, stretch, ["t_us"], lasts={"_claimed": F.when(F.col("_before").isNull(), F.col("t_us"))}, width=width)
    confidence = F.when(F.col("_reached") >= F.col("_since"), 0.85).otherwise(0.4)
    return _edge(out, "interacting_with", "person", "thing", confidence, F.col("t_us") - F.col("_claimed"))


def dedupe_relations(edges: DataFrame) -> DataFrame:
    """One row per frame, relation and pair; all but ``interacting_with`` count unordered."""
    symmetric = F.col("relation") != "interacting_with"
    ends = (F.col("subject_track"), F.col("object_track"))
    keyed = edges.withColumns(
        {"_a": F.when(symmetric, F.least(*ends)).otherwise(ends[0]), "_b": F.when(symmetric, F.greatest(*ends)).otherwise(ends[1])}
    )
    return keyed.dropDuplicates(["source_id", "step", "relation", "_a", "_b"]).drop("_a", "_b")


def relations(tracks: DataFrame, settings: RelationSettings = RelationSettings(), *, width: int = SLICE_US) -> DataFrame:
    """Every relation holding on every frame."""
    pairs = pair_history(tracks, settings, width=width)
    found = near_relation(pairs, settings, width=width).unionByName(closing_rate(pairs, settings, width=width))
    return found.unionByName(interaction(pairs, settings, width=width))
