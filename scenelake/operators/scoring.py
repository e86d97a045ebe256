"""Scoring predictions against truth tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.boxes import iou
from scenelake.operators.assignment import best_matching
from scenelake.plans.components import component_of
from scenelake.plans.segments import SLICE, carry
from scenelake.session import settle


def anomaly_scores(flagged: DataFrame, planted: DataFrame, by: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Found, missed and false positives per group, from one aggregation of both sets."""
    keys = [*by, *on]
    both = flagged.select(*keys, F.lit(1).alias("_f"), F.lit(0).alias("_p")).unionByName(planted.select(*keys, F.lit(0).alias("_f"), F.lit(1).alias("_p")))
    each = both.groupBy(*keys).agg(F.max("_f").alias("_f"), F.max("_p").alias("_p"))
    f, p = F.col("_f") == 1, F.col("_p") == 1
    out = each.groupBy(*by).agg(F.count_if(f & p).alias("found"), F.count_if(p & ~f).alias("missed"), F.count_if(f & ~p).alias("false_positives"))
    planted_n = F.col("found") + F.col("missed")
    return out.withColumns(
        {
            "recall": F.when(planted_n > 0, F.col("found") / planted_n).otherwise(1.0),
            "passed": (F.col("missed") == 0) & (F.col("false_positives") == 0),
        }
    )


def found(flagged: DataFrame, planted: DataFrame) -> DataFrame:
    return flagged.intersect(planted)


def missed(flagged: DataFrame, planted: DataFrame) -> DataFrame:
    return planted.subtract(flagged)


def false_positives(flagged: DataFrame, planted: DataFrame) -> DataFrame:
    return flagged.subtract(planted)


# --- tracking accuracy ----------------------------------------------------------------------

FRAMES_PER_SLICE = 100_000
_MATCH = ("source_id", "frame_index", "object_id", "track_id", "iou")


def overlaps(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of true and predicted boxes of a frame that meet at all."""
    t = truth.select("source_id", "frame_index", "object_id", F.col("box").alias("_tb"))
    p = pred.select("source_id", "frame_index", "track_id", F.col("box").alias("_pb"))
    met = t.join(p, ["source_id", "frame_index"]).withColumn("iou", iou(F.col("_tb"), F.col("_pb")))
    return met.where(F.col("iou") > 0).drop("_tb", "_pb")


def _contested_frames(threshold: float):
    """Contested frames in order: the pairing of the frame before has priority. Only one frame's rows and one group's latest pairings are held."""

    def pair(rows: list[tuple], latest: dict) -> list[tuple]:
        weights = {(o, t): w for _, _, o, t, w, _, _ in rows}
        for _, _, o, _, _, at, t in rows:
            if at >= 0 and at > latest.get(o, (-1, None))[0]:
                latest[o] = (at, t)
        used_o, used_t, pairs = set(), set(), []
        for o in sorted({o for o, _ in weights}):
            t = latest.get(o, (-1, None))[1]
            if t is not None and t not in used_t and weights.get((o, t), 0.0) >= threshold:
                pairs.append((o, t))
                used_o.add(o)
                used_t.add(t)
        free = [(o, t, w) for (o, t), w in weights.items() if o not in used_o and t not in used_t]
        pairs += [(o, t) for o, t in best_matching(free).items() if weights[o, t] >= threshold]
        source, frame = rows[0][:2]
        latest.update((o, (frame, t)) for o, t in pairs)
        return [(source, frame, o, t, weights[o, t]) for o, t in pairs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, frame, rows, latest = None, None, [], {}
        for pdf in batches:
            out = []
            for part, *row in zip(pdf["_component"].tolist(), *[pdf[c].tolist() for c in (*_MATCH, "forced_frame", "forced_track")]):
                if rows and (part, row[0], row[1]) != (*group, frame):
                    out += pair(rows, latest)
                    rows = []
                if (part, row[0]) != group:
                    group, latest = (part, row[0]), {}
                frame = row[1]
                rows.append(tuple(row))
            yield pd.DataFrame(out, columns=list(_MATCH))
        if rows:
            yield pd.DataFrame(pair(rows, latest), columns=list(_MATCH))

    return run


def match_truth(truth: DataFrame, pred: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs per frame: a pairing that held last time is kept, the rest is the best overall.

    Where an object meets one prediction and that prediction meets nothing else, the pair is settled
    without looking anywhere else; that is nearly every frame. Of contested frames those objects are walked together
    that compete in a frame, directly or over others, and a walk goes on to the next frame only with an object
    that is contested again before it is next paired without a doubt.
    """
    pairs = overlaps(truth, pred)
    frame = ["source_id", "frame_index"]
    by_object, by_track = Window.partitionBy(*frame, "object_id"), Window.partitionBy(*frame, "track_id")
    one = F.count(F.lit(1))
    visit = lambda at: F.xxhash64("source_id", at, "object_id")
    pairs = pairs.withColumns({"_free": one.over(by_object) == 1, "_able": F.max("iou").over(by_object) >= iou_threshold, "_visit": visit("frame_index")})
    pairs = pairs.withColumns({"_free": F.col("_free") & (one.over(by_track) == 1), "_hub": F.min("_visit").over(by_track)})
    # A visit is found again from the ids, and a hub counts only for pairs in doubt.
    pairs = settle(pairs.withColumn("_hub", F.when(~F.col("_free"), F.col("_hub"))).drop("_visit"))
    forced = pairs.where(F.col("_free") & F.col("_able")).select(*_MATCH)
    contested = pairs.where(~F.col("_free")).withColumn("_visit", visit("frame_index"))
    if contested.isEmpty():
        return forced
    # An object no prediction of the frame is close enough to neither keeps a pairing nor makes one there.
    seen = forced.select("source_id", "object_id", "frame_index", F.col("track_id").alias("_ft"), F.lit(False).alias("_c"))
    doubt = contested.where("_able").select("source_id", "object_id", "frame_index", F.lit(None).cast(forced.schema["track_id"].dataType).alias("_ft"), F.lit(True).alias("_c")).distinct()
    known = F.col("_ft").isNotNull()
    line = carry(
        seen.unionByName(doubt), ["source_id", "object_id"], ["frame_index"],
        befores={"forced_frame": F.when(known, F.col("frame_index")), "forced_track": F.col("_ft"), "_doubt": F.when(F.col("_c"), F.col("frame_index"))},
        width=FRAMES_PER_SLICE,
    ).drop(SLICE)
    line = settle(line.where("_c").drop("_ft", "_c"))
    ties = line.where(F.col("_doubt") > F.coalesce("forced_frame", F.lit(-1))).select(visit("frame_index").alias("a"), visit("_doubt").alias("b"))
    competing = contested.where("_visit <> _hub").select(F.col("_visit").alias("a"), F.col("_hub").alias("b"))
    parts = component_of(competing.unionByName(ties)).select(F.col("node").alias("_visit"), F.col("component").alias("_component"))
    rows = contested.join(line.drop("_doubt"), [*frame, "object_id"], "left").join(parts, "_visit", "left")
    rows = rows.select(
        *_MATCH, F.coalesce("forced_frame", F.lit(-1)).alias("forced_frame"), F.coalesce("forced_track", "track_id").alias("forced_track"),
        F.coalesce("_component", "_visit").alias("_component"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in _MATCH)
    dealt = rows.repartition("_component").sortWithinPartitions("_component", *frame, "object_id", "track_id")
    return forced.unionByName(dealt.mapInPandas(_contested_frames(iou_threshold), schema))


def track_history(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """True boxes with the track each was matched to, and whether that is a switch or a resumption."""
    on = ["source_id", "frame_index", "object_id"]
    rows = truth.select(*on).join(matches, on, "left")
    hit = F.col("track_id").isNotNull()
    out = carry(
        rows, ["source_id", "object_id"], ["frame_index"],
        befores={"_last": F.col("track_id"), "_was": hit}, width=FRAMES_PER_SLICE,
    ).drop(SLICE)
    return out.select(
        *on, "track_id", "iou",
        (hit & F.col("_last").isNotNull() & (F.col("_last") != F.col("track_id"))).alias("switch"),
        (hit & F.col("_last").isNotNull() & ~F.col("_was")).alias("resumed"),
    )


def clear_mot(truth: DataFrame, pred: DataFrame, iou_threshold: float = 0.5, matches: DataFrame | None = None) -> DataFrame:
    """Raw tracking counts per source: every ratio can be taken from them, or from their sums."""
    found = settle(match_truth(truth, pred, iou_threshold)) if matches is None else matches
    rows = settle(track_history(truth, found))
    hit = F.col("track_id").isNotNull()
    total = rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("ground_truth"), F.count_if(hit).alias("true_positives"), F.coalesce(F.sum("iou"), F.lit(0.0)).alias("total_iou"),
        F.count_if("switch").alias("id_switches"), F.count_if("resumed").alias("fragmentations"),
    )
    life = rows.groupBy("source_id", "object_id").agg((F.count_if(hit) / F.count(F.lit(1))).alias("_share"))
    life = life.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("gt_objects"), F.count_if(F.col("_share") >= 0.8).alias("mostly_tracked"), F.count_if(F.col("_share") < 0.2).alias("mostly_lost")
    )
    said = pred.groupBy("source_id").agg(F.count(F.lit(1)).alias("predictions"))
    out = total.join(life, "source_id").join(said, "source_id", "left").withColumn("predictions", F.coalesce("predictions", F.lit(0).cast("long")))
    return out.withColumns(
        {"false_positives": F.col("predictions") - F.col("true_positives"), "false_negatives": F.col("ground_truth") - F.col("true_positives")}
    )


def _sure_pairs(shared: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pairs of some best pairing, as parts, and the links that are left when these and all that compete with them are set aside.

    A pair that weighs as much as the heaviest other link of its object and the heaviest other link of its track together can be taken
    for both in any pairing. Links of ends taken go, which makes further pairs sure, in rounds.
    """
    sure, at_object, at_track = [], ["source_id", "object_id"], ["source_id", "track_id"]
    left = shared
    while True:
        by_object = Window.partitionBy(*at_object).orderBy(F.desc("n"), "track_id")
        by_track = Window.partitionBy(*at_track).orderBy(F.desc("n"), "object_id")
        rank = F.row_number()
        ranked = left.withColumns({"_ro": rank.over(by_object), "_no": F.lead("n", 1, 0).over(by_object)})
        ranked = ranked.withColumns({"_rt": rank.over(by_track), "_nt": F.lead("n", 1, 0).over(by_track)})
        take = (F.col("_ro") == 1) & (F.col("_rt") == 1) & (F.col("n") >= F.col("_no") + F.col("_nt"))
        ranked = ranked.withColumn("_take", take)
        ranked = ranked.withColumn("_gone", F.max("_take").over(Window.partitionBy(*at_track)))
        ranked = settle(ranked.withColumn("_gone", F.col("_gone") | F.max("_take").over(Window.partitionBy(*at_object))).drop("_ro", "_rt", "_no", "_nt"))
        sure.append(ranked.where("_take").select(*shared.columns))
        left = ranked.where("not _gone").select(*shared.columns)
        if left.isEmpty() or sure[-1].isEmpty():
            return sure, left


def _best_totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames shared under the best pairing of each component, one component held at a time."""
    part, source, links = None, None, []
    total = lambda: (source, int(sum({(o, t): n for o, t, n in links}[pair] for pair in best_matching(links).items())))
    for pdf in batches:
        out = []
        for new, where, o, t, n in zip(*[pdf[c].tolist() for c in ("_component", "source_id", "object_id", "track_id", "n")]):
            if links and (new, where) != (part, source):
                out.append(total())
                links = []
            part, source = new, where
            links.append((o, t, float(n)))
        yield pd.DataFrame(out, columns=["source_id", "idtp"])
    if links:
        yield pd.DataFrame([total()], columns=["source_id", "idtp"])


def idf1(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Identity counts per source under the best one-to-one pairing of whole trajectories.

    Frames are counted per (object, track) first. Pairs that no other pairing can better are settled
    by the counts alone; of the others those that compete, directly or over others, meet in a task.
    """
    shared = settle(matches.groupBy("source_id", "object_id", "track_id").agg(F.count(F.lit(1)).alias("n")))
    sure, left = _sure_pairs(shared)
    parts = [s.groupBy("source_id").agg(F.sum("n").alias("idtp")) for s in sure]
    if not left.isEmpty():
        ends = left.withColumns({"_o": F.xxhash64("source_id", F.lit(0), "object_id"), "_t": F.xxhash64("source_id", F.lit(1), "track_id")})
        groups = component_of(ends.select(F.col("_o").alias("a"), F.col("_t").alias("b"))).select(F.col("node").alias("_o"), F.col("component").alias("_component"))
        dealt = ends.join(groups, "_o").drop("_o", "_t").repartition("_component").sortWithinPartitions("_component", "source_id")
        parts.append(dealt.mapInPandas(_best_totals, "source_id string, idtp long"))
    idtp = reduce(DataFrame.unionByName, parts).groupBy("source_id").agg(F.sum("idtp").alias("idtp"))
    t = truth.groupBy("source_id").agg(F.count(F.lit(1)).alias("_t"))
    p = pred.groupBy("source_id").agg(F.count(F.lit(1)).alias("_p"))
    zero = F.lit(0).cast("long")
    out = t.join(p, "source_id", "left").join(idtp, "source_id", "left")
    out = out.withColumns({"idtp": F.coalesce("idtp", zero), "_p": F.coalesce("_p", zero)})
    return out.select("source_id", "idtp", (F.col("_p") - F.col("idtp")).alias("idfp"), (F.col("_t") - F.col("idtp")).alias("idfn"))


_COUNTS = (
    "ground_truth", "true_positives", "false_positives", "false_negatives", "total_iou", "id_switches", "fragmentations", "gt_objects",
    "mostly_tracked", "mostly_lost", "idtp", "idfp", "idfn",
)


def pool(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratios from summed raw counts, so a short sequence weighs as little as it should."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _COUNTS if c in counts.columns])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    c = F.col
    wrong = c("false_negatives") + c("false_positives") + c("id_switches")
    return s.withColumns(
        {
            "mota": F.when(c("ground_truth") > 0, 1.0 - wrong / c("ground_truth")).otherwise(0.0),
            "motp": ratio(c("total_iou"), c("true_positives")),
            "idf1": ratio(2 * c("idtp"), 2 * c("idtp") + c("idfp") + c("idfn")),
            "recall": ratio(c("true_positives"), c("ground_truth")),
            "precision": ratio(c("true_positives"), c("true_positives") + c("false_positives")),
        }
    )


def objective(pooled: DataFrame) -> DataFrame:
    """One number to rank trackers by: identity first, then coverage, then fit, less a little per switch."""
    per = F.col("id_switches") / F.greatest(F.col("gt_objects"), F.lit(1))
    return pooled.withColumn("objective", 0.60 * F.col("idf1") + 0.30 * F.col("mota") + 0.10 * F.col("motp") - 0.02 * per)


def worst_case_objective(counts: DataFrame, candidate: str = "candidate", scenario: str = "scenario") -> DataFrame:
    """Per candidate three quarters of the pooled objective and one quarter of its worst scenario."""
    pooled = objective(pool(counts, [candidate])).select(candidate, F.col("objective").alias("_all"))
    worst = objective(pool(counts, [candidate, scenario])).groupBy(candidate).agg(F.min("objective").alias("worst"))
    return pooled.join(worst, candidate).select(candidate, F.col("_all").alias("pooled"), "worst", (0.75 * F.col("_all") + 0.25 * F.col("worst")).alias("objective"))


MIN_IMPROVEMENT = 0.001


def accepted(ranked: DataFrame, baseline: str, candidate: str = "candidate") -> DataFrame:
    """Candidates that beat the baseline by more than noise."""
    base = ranked.where(F.col(candidate) == baseline).select(F.col("objective").alias("_base"), F.lit(1).alias("_one"))
    joined = ranked.withColumn("_one", F.lit(1)).join(base, "_one")
    return joined.where(F.col("objective") > F.col("_base") + MIN_IMPROVEMENT).drop("_base", "_one")


# --- activities and relations against scripts -----------------------------------------------


def activity_scores(active: DataFrame, expected: DataFrame, moments: DataFrame, forbidden: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Per scenario: recall on scored frames, moments found once and how late, forbidden firings.

    ``active`` has (scenario, step, t_s, activity), ``expected`` (scenario, step, activity), ``moments``
    (scenario, activity, boundary_s), ``forbidden`` (scenario, activity), ``scenarios`` (scenario).
    """
    now = settle(active.select("scenario", "step", "t_s", "activity").distinct())
    hits = expected.join(now.select("scenario", "step", "activity", F.lit(1).alias("_hit")), ["scenario", "step", "activity"], "left")
    recall = hits.groupBy("scenario").agg(F.count(F.lit(1)).alias("expected_total"), F.count("_hit").alias("expected_hits"))
    fired = now.join(moments, ["scenario", "activity"])
    fired = carry(fired, ["scenario", "activity"], ["step"], befores={"_before": F.col("step")}, width=FRAMES_PER_SLICE).drop(SLICE)
    starts = fired.where(~F.col("_before").eqNullSafe(F.col("step") - 1))
    starts = starts.groupBy("scenario", "activity").agg(F.count(F.lit(1)).alias("_n"), F.min("t_s").alias("_t"))
    events = moments.join(starts, ["scenario", "activity"], "left")
    events = events.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("events_expected"), F.count("_n").alias("events_found"),
        F.coalesce(F.sum(F.greatest(F.col("_n") - 1, F.lit(0))), F.lit(0)).alias("event_duplicates"),
        F.max(F.greatest(F.col("_t") - F.col("boundary_s"), F.lit(0.0))).alias("latency_s"),
    )
    banned = now.join(forbidden, ["scenario", "activity"]).groupBy("scenario").agg(F.count(F.lit(1)).alias("forbidden_firings"))
    out = scenarios.select("scenario")
    for part in (recall, events, banned):
        out = out.join(part, "scenario", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(c, zero) for c in ("expected_total", "expected_hits", "events_expected", "events_found", "event_duplicates", "forbidden_firings")})
    out = out.withColumn("recall", F.when(F.col("expected_total") > 0, F.col("expected_hits") / F.col("expected_total")).otherwise(1.0))
    ok = (F.col("recall") >= 0.9) & (F.col("forbidden_firings") == 0) & (F.col("events_found") == F.col("events_expected")) & (F.col("event_duplicates") == 0)
    return out.withColumn("passed", ok)


def spatial_scores(
    edges: DataFrame, crossings: DataFrame, expected: DataFrame, forbidden: DataFrame, zone_events: DataFrame, scenarios: DataFrame
) -> DataFrame:
    """Per scenario: expected relations found, forbidden ones after the grace, zone events found, peak confidence.

    ``edges`` has (scenario, t_s, relation, a, b, confidence) with symmetric ends in order; ``expected`` and
    ``forbidden`` (scenario, relation, a, b); ``zone_events`` and ``crossings`` (scenario, track_id, zone, event);
    ``scenarios`` (scenario, grace_s).
    """
    key = ["scenario", "relation", "a", "b"]
    seen = edges.groupBy(*key).agg(F.max("confidence").alias("_peak"))
    want = expected.join(seen, key, "left").groupBy("scenario").agg(
        F.count(F.lit(1)).alias("relations_expected"), F.count("_peak").alias("relations_found"), F.max("_peak").alias("peak_confidence")
    )
    late = edges.join(scenarios, "scenario").where(F.col("t_s") >= F.col("grace_s"))
    banned = late.join(forbidden, key, "left_semi").groupBy("scenario").agg(F.count(F.lit(1)).alias("forbidden_firings"))
    spot = ["scenario", "track_id", "zone", "event"]
    crossed = zone_events.join(crossings.select(*spot).distinct().withColumn("_hit", F.lit(1)), spot, "left")
    crossed = crossed.groupBy("scenario").agg(F.count(F.lit(1)).alias("zone_events_expected"), F.count("_hit").alias("zone_events_found"))
    out = scenarios.select("scenario")
    for part in (want, banned, crossed):
        out = out.join(part, "scenario", "left")
    zero = F.lit(0).cast("long")
    names = ("relations_expected", "relations_found", "forbidden_firings", "zone_events_expected", "zone_events_found")
    out = out.withColumns({c: F.coalesce(c, zero) for c in names})
    ok = (F.col("relations_found") == F.col("relations_expected")) & (F.col("forbidden_firings") == 0) & (F.col("zone_events_found") == F.col("zone_events_expected"))
    return out.withColumn("passed", ok)
