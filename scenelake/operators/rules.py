"""Rules that turn activities, zones and relations into debounced events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.clock import us
from scenelake.operators.activity import ACTIVITIES
from scenelake.operators.zones import crossings, occupied, zone_occupancy
from scenelake.plans.greedy import greedy_spacing
from scenelake.plans.segments import SLICE_US

# Severities from least to most, relation names.
SEVERITIES = ("info", "notice", "alert")
RELATIONS = ("near", "approaching", "receding", "interacting_with")
RULE_TYPES = ("activity", "zone_entry", "zone_exit", "zone_dwell", "zone_occupancy", "relation")
CUSTOM_RULES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_rule(name: str, candidates: Callable[[DataFrame], DataFrame]) -> None:
    """Add a rule type: activity rows in, candidate rows (``CANDIDATE`` less the rule's own columns) out."""
    CUSTOM_RULES[name] = candidates


@dataclass(frozen=True)
class RuleSpec:
    """One rule. Empty ``zones`` or ``labels`` mean any."""

    type: str
    name: str = ""
    severity: str = "info"
    cooldown_s: float = 5.0
    zones: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    activity: str = ""
    relation: str = ""
    min_confidence: float = 0.0
    min_seconds: float = 0.0
    min_count: int = 2

    def __post_init__(self) -> None:
        if self.type not in RULE_TYPES and self.type not in CUSTOM_RULES:
            raise ValueError(f"unknown rule type {self.type!r}; available: {sorted([*RULE_TYPES, *CUSTOM_RULES])}")
        if self.severity not in SEVERITIES:
            raise ValueError(f"unknown severity {self.severity!r}")
        if self.cooldown_s < 0:
            raise ValueError("cooldown_s must be >= 0")
        if not 0.0 <= self.min_confidence <= 1.0:
            raise ValueError("min_confidence must be in [0, 1]")
        if self.type == "activity" and self.activity not in ACTIVITIES:
            raise ValueError(f"unknown activity {self.activity!r}; available: {ACTIVITIES}")
        if self.type == "relation" and self.relation not in RELATIONS:
            raise ValueError(f"unknown relation {self.relation!r}; available: {RELATIONS}")
        if self.type == "zone_occupancy" and self.min_count < 1:
            raise ValueError("min_count must be >= 1")

    @property
    def label(self) -> str:
        parts = [self.type, self.activity, self.relation, "+".join(self.zones)]
        return self.name or ":".join(p for p in parts if p)

    def wants(self, label: Column | None = None, zone: Column | None = None) -> Column:
        ok = F.lit(True)
        if label is not None and self.labels:
            ok &= F.lower(label).isin([n.lower() for n in self.labels])
        if zone is not None and self.zones:
            ok &= F.coalesce(zone.isin(list(self.zones)), F.lit(False))
        return ok


DEFAULT_RULES = (
    RuleSpec("activity", "fall", "alert", 15.0, activity="falling"),
    RuleSpec("activity", "running", "notice", activity="running", min_seconds=1.0),
    RuleSpec("activity", "loitering", "notice", 60.0, activity="loitering"),
    RuleSpec("zone_entry", severity="info", cooldown_s=2.0),
    RuleSpec("zone_exit", severity="info", cooldown_s=2.0),
)

CANDIDATE = (
    "source_id", "step", "t_us", "rule", "rule_order", "severity", "cooldown_us", "island", "track_id", "entity_id", "related_id", "zone",
    "summary", "evidence",
)


def severity_rank(severity: Column) -> Column:
    out = F.when(severity == SEVERITIES[0], 0)
    for rank, name in enumerate(SEVERITIES[1:], start=1):
        out = out.when(severity == name, rank)
    return out


def highest_severity(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most severe level per group."""
    return events.groupBy(*by).agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))


def _matched(rows: DataFrame, rules: Sequence[tuple[int, RuleSpec]], applies: Callable[[RuleSpec], Column], zone: Callable[[RuleSpec], Column] | None = None) -> DataFrame:
    """All rules of one type in one pass over the rows; several may match a row."""
    hits = [
        F.when(
            applies(rule),
            F.struct(
                F.lit(rule.label).alias("rule"),
                F.lit(order).alias("rule_order"),
                F.lit(rule.severity).alias("severity"),
                F.lit(us(rule.cooldown_s)).cast("long").alias("cooldown_us"),
                F.lit(float(rule.min_seconds)).alias("min_seconds"),
                F.lit(rule.min_count).alias("min_count"),
                (zone(rule) if zone else F.lit(None).cast("string")).alias("rule_zone"),
            ),
        )
        for order, rule in rules
    ]
    return rows.select("*", F.inline(F.array_compact(F.array(*hits))))


def _candidates(rows: DataFrame, *, summary: Column, evidence: dict[str, Column], entity: str | None, zone: Column | None, related: str | None = None) -> DataFrame:
    none = F.lit(None)
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        "source_id", "step", "t_us", "rule", "rule_order", "severity", "cooldown_us",
        (F.col("island") if entity else F.lit(-1)).cast("long").alias("island"),
        (F.col("track_id") if entity else none).cast("long").alias("track_id"),
        (F.col(entity) if entity else none).cast("string").alias("entity_id"),
        (F.col(related) if related else none).cast("string").alias("related_id"),
        (zone if zone is not None else none).cast("string").alias("zone"),
        summary.alias("summary"),
        F.create_map(*pairs).alias("evidence"),
    )


def entity_zones(visits: DataFrame) -> DataFrame:
    """Zones an entity is in, in zone order, one row per entity and step."""
    inside = occupied(visits).groupBy("source_id", "track_id", "step").agg(F.array_sort(F.collect_list(F.struct("zone_order", "zone"))).alias("_z"))
    return inside.select("source_id", "track_id", "step", F.col("_z.zone").alias("zones"))


def activity_zone_join(rows: DataFrame, visits: DataFrame | None) -> DataFrame:
    """Activity rows with the list of zones the entity is in (empty when in none)."""
    if visits is None:
        return rows.withColumn("zones", F.array().cast("array<string>"))
    joined = rows.join(entity_zones(visits), ["source_id", "track_id", "step"], "left")
    return joined.withColumn("zones", F.coalesce("zones", F.array().cast("array<string>")))


def _words(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def activity_candidates(rows: DataFrame, rules: Sequence[tuple[int, RuleSpec]], visits: DataFrame | None = None) -> DataFrame:
    """An entity is doing a named thing, surely and long enough, in a wanted zone."""
    zoned = activity_zone_join(rows.where(F.col("activity").isin([r.activity for _, r in rules])), visits)

    def first_zone(rule: RuleSpec) -> Column:
        if not rule.zones:
            return F.try_element_at("zones", F.lit(1))
        return F.try_element_at(F.filter("zones", lambda z: z.isin(list(rule.zones))), F.lit(1))

    def applies(rule: RuleSpec) -> Column:
        ok = (F.col("activity") == rule.activity) & rule.wants(F.col("label"))
        ok &= (F.col("confidence") >= rule.min_confidence) & (F.col("duration_s") >= rule.min_seconds)
        return ok & first_zone(rule).isNotNull() if rule.zones else ok

    hit = _matched(zoned, rules, applies, first_zone)
    place = F.coalesce(F.concat(F.lit(" in "), F.col("rule_zone")), F.lit(""))
    return _candidates(
        hit,
        summary=F.concat(F.col("entity_id"), F.lit(" is "), _words(F.col("activity")), place),
        evidence={"activity": F.col("activity"), "confidence": F.round("confidence", 3), "duration_s": F.round("duration_s", 2)},
        entity="entity_id",
        zone=F.col("rule_zone"),
    )


def crossing_candidates(visits: DataFrame, rules: Sequence[tuple[int, RuleSpec]]) -> DataFrame:
    """Entries and exits of zones."""
    kind = {"zone_entry": "entered", "zone_exit": "exited"}
    hit = _matched(
        crossings(visits), rules, lambda r: (F.col("event") == kind[r.type]) & r.wants(F.col("label"), F.col("zone"))
    )
    verb = F.when(F.col("event") == "entered", " entered ").otherwise(" left ")
    return _candidates(
        hit,
        summary=F.concat(F.col("entity_id"), verb, F.col("zone")),
        evidence={"zone_kind": F.col("zone_kind"), "dwell_s": F.round("dwell_s", 2)},
        entity="entity_id",
        zone=F.col("zone"),
    )


def dwell_candidates(visits: DataFrame, rules: Sequence[tuple[int, RuleSpec]]) -> DataFrame:
    """In a zone for at least ``min_seconds``."""
    hit = _matched(occupied(visits), rules, lambda r: (F.col("dwell_s") >= r.min_seconds) & r.wants(F.col("label"), F.col("zone")))
    return _candidates(
        hit,
        summary=F.concat(F.col("entity_id"), F.lit(" has been in "), F.col("zone"), F.lit(" for "), F.format_string("%.0f", F.col("dwell_s")), F.lit("s")),
        evidence={"dwell_s": F.round("dwell_s", 2), "threshold_s": F.col("min_seconds"), "zone_kind": F.col("zone_kind")},
        entity="entity_id",
        zone=F.col("zone"),
    )


def occupancy_candidates(visits: DataFrame, rules: Sequence[tuple[int, RuleSpec]]) -> DataFrame:
    """A zone holds at least ``min_count`` entities; about the place, so no entity."""
    hit = _matched(zone_occupancy(visits), rules, lambda r: (F.col("entities") >= r.min_count) & r.wants(zone=F.col("zone")))
    return _candidates(
        hit,
        summary=F.concat(F.col("entities").cast("string"), F.lit(" entities in "), F.col("zone")),
        evidence={"count": F.col("entities"), "threshold": F.col("min_count")},
        entity=None,
        zone=F.col("zone"),
    )


def relation_candidates(edges: DataFrame, rules: Sequence[tuple[int, RuleSpec]]) -> DataFrame:
    """A spatial relation, surely and long enough."""

    def applies(rule: RuleSpec) -> Column:
        ok = F.col("relation") == rule.relation
        return ok & (F.col("confidence") >= rule.min_confidence) & (F.col("duration_s") >= rule.min_seconds)

    hit = _matched(edges, rules, applies).withColumns({"track_id": F.col("subject_track"), "island": F.col("subject_island")})
    return _candidates(
        hit,
        summary=F.concat_ws(" ", F.col("subject_id"), _words(F.col("relation")), F.col("object_id")),
        evidence={
            "relation": F.col("relation"),
            "confidence": F.round("confidence", 3),
            "distance_heights": F.round("distance", 3),
            "duration_s": F.round("duration_s", 2),
        },
        entity="subject_id",
        related="object_id",
        zone=None,
    )


def with_subject_island(edges: DataFrame, tracks: DataFrame) -> DataFrame:
    """Relation rows with the subject's presence island, which its cooldown belongs to."""
    subject = tracks.select("source_id", F.col("track_id").alias("subject_track"), "step", F.col("island").alias("subject_island"))
    return edges.join(subject, ["source_id", "subject_track", "step"])


def rule_candidates(
    rules: Sequence[RuleSpec] = DEFAULT_RULES,
    *,
    activities: DataFrame | None = None,
    visits: DataFrame | None = None,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Every rule's candidates, one pass per rule type. No rules means the defaults.

    Rules of one label share their memory of what fired, so they must agree on the cooldown.
    """
    numbered = list(enumerate(rules or DEFAULT_RULES))
    cooldowns: dict[str, float] = {}
    for _, rule in numbered:
        if cooldowns.setdefault(rule.label, rule.cooldown_s) != rule.cooldown_s:
            raise ValueError(f"rules labelled {rule.label!r} differ in cooldown: give them names of their own")

    def of(*types: str) -> list[tuple[int, RuleSpec]]:
        return [(i, r) for i, r in numbered if r.type in types]

    parts = []
    if activities is not None and of("activity"):
        parts.append(activity_candidates(activities, of("activity"), visits))
    if visits is not None:
        for types, make in ((("zone_entry", "zone_exit"), crossing_candidates), (("zone_dwell",), dwell_candidates), (("zone_occupancy",), occupancy_candidates)):
            if of(*types):
                parts.append(make(visits, of(*types)))
    if edges is not None and of("relation"):
        parts.append(relation_candidates(edges, of("relation")))
    for order, rule in numbered:
        if rule.type in CUSTOM_RULES and activities is not None:
            own = {"rule": F.lit(rule.label), "rule_order": F.lit(order), "severity": F.lit(rule.severity), "cooldown_us": F.lit(us(rule.cooldown_s)).cast("long")}
            parts.append(CUSTOM_RULES[rule.type](activities).withColumns(own).select(*CANDIDATE))
    if not parts:
        raise ValueError("no input given for any of the rules")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def debounce(candidates: DataFrame, *, width: int = SLICE_US) -> DataFrame:
    """Adds ``fired``: a rule stays silent about an entity until its cooldown has passed since it last fired.

    Memory is per (source, rule, entity) and ends when the entity leaves. Of several candidates of
    one entity on one frame the first by rule and zone order fires.
    """
    keyed = candidates.withColumn("_who", F.coalesce("entity_id", F.lit("")))
    keys = ["source_id", "rule", "_who", "island"]
    tie = ["rule_order", "zone", "related_id"]
    filled = keyed.withColumns({c: F.coalesce(c, F.lit("")) for c in ("zone", "related_id")})
    out = greedy_spacing(filled, keys, "t_us", "cooldown_us", tie, width=width)
    blank = {c: F.nullif(c, F.lit("")) for c in ("zone", "related_id")}
    return out.withColumns(blank).withColumnRenamed("kept", "fired").drop("_who")


def evaluate_rules(rules: Sequence[RuleSpec] = DEFAULT_RULES, *, width: int = SLICE_US, **inputs: DataFrame) -> DataFrame:
    """Candidates of all rules with ``fired`` set by their cooldowns."""
    return debounce(rule_candidates(rules, **inputs), width=width)


def rule_stats(debounced: DataFrame, by: Sequence[str] = ("rule",)) -> DataFrame:
    """Raised and suppressed per rule."""
    return debounced.groupBy(*by).agg(F.count_if("fired").alias("raised"), F.count_if(~F.col("fired")).alias("suppressed"))


def retired_keys(memory: DataFrame, live: DataFrame, on: Sequence[str] = ("source_id", "entity_id")) -> DataFrame:
    """Remembered keys whose entity is no longer live; scene-level keys (no entity) stay."""
    return memory.where(F.col("entity_id").isNotNull()).join(live.select(*on), list(on), "left_anti")
