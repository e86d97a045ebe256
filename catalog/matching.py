"""Galleries, votes, scoring and linking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import views as v
from scenelake.functions.boxes import box
from scenelake.functions.vectors import cosine
from scenelake.operators import gallery as g
from scenelake.operators import linking as ln
from scenelake.operators import scoring as sc
from scenelake.session import settle

Q: dict[str, tuple] = {}


def vectors(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.withColumn("consent", F.col("label") % 5 != 4)


def _gallery(spark, d):
    return g.build_gallery(vectors(spark, d), consent="consent", dimensions=64)


_GAL = {
    "dims": "SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS n FROM embeddings, range(1, 65) t(i) WHERE label % 5 <> 4 GROUP BY label, i",
    "gal": "SELECT label, any_value(n) AS samples, list(m / s ORDER BY i) AS template FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS s FROM dims) GROUP BY label",
    "cosn": """SELECT vec_id, CAST(gal.label AS VARCHAR) AS name, list_dot_product(CAST(embedding AS DOUBLE[]), template) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) *
        sqrt(list_dot_product(template, template))) AS s FROM embeddings, gal""",
    "rnk": "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS r FROM cosn",
    "top2": "SELECT vec_id, max(name) FILTER (r = 1) AS best, max(s) FILTER (r = 1) AS s1, max(name) FILTER (r = 2) AS second, max(s) FILTER (r = 2) AS s2 FROM rnk WHERE r <= 2 GROUP BY vec_id",
}


def templates(spark, d):
    t = _gallery(spark, d)
    return t.select(F.col("name").cast("long").alias("name"), F.round(F.element_at("template", 1), 6).alias("first"), F.round(F.element_at("template", 64), 6).alias("last"), "samples")


Q["build_gallery"] = (templates, v.sql("SELECT CAST(label AS BIGINT) AS name, round(template[1], 6) AS first, round(template[64], 6) AS last, samples FROM gal", ctes=_GAL))
Q["refused_vectors"] = (
    lambda spark, d: g.refused_vectors(vectors(spark, d), consent="consent", dimensions=64),
    "SELECT 'no_consent' AS reason, count(*) AS n FROM embeddings WHERE label % 5 = 4",
)


def matched(spark, d):
    out = g.match_gallery(vectors(spark, d), _gallery(spark, d), threshold=0.20, margin=0.05)
    return out.select("vec_id", "name", F.round("similarity", 6).alias("similarity"), "runner_up", F.round("runner_up_similarity", 6).alias("runner_up_similarity"))


_MATCHED = v.sql(
    """SELECT vec_id, CASE WHEN s1 >= 0.20 AND s1 - s2 >= 0.05 THEN best ELSE 'unknown' END AS name, round(s1, 6) AS similarity, second AS runner_up, round(s2, 6) AS runner_up_similarity FROM top2""", ctes=_GAL
)
Q["match_gallery"] = (matched, _MATCHED)


def matched_in_blocks(spark, d):
    """The same through the route a gallery too large for one task takes."""
    out = g.match_gallery(vectors(spark, d), _gallery(spark, d), threshold=0.20, margin=0.05, block=3)
    return out.select("vec_id", "name", F.round("similarity", 6).alias("similarity"), "runner_up", F.round("runner_up_similarity", 6).alias("runner_up_similarity"))


Q["match_gallery_blocks"] = (matched_in_blocks, _MATCHED)
Q["vector_cosine"] = (
    lambda spark, d: vectors(spark, d).select("vec_id", F.round(cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine")),
    """SELECT vec_id, round(list_dot_product(e, list_reverse(e)) / list_dot_product(e, e), 6) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
)


def _audit(spark, d):
    return v.observations(spark, d).select(
        "id", "timestamp", "us", F.element_at(F.array(*[F.lit(x) for x in g.AUDIT_ACTIONS]), (F.col("k") % 4 + 1).cast("int")).alias("action"), F.col("entity_id").alias("name")
    )


_AUD = {"audit": "SELECT id, us, ['enrolled', 'revoked', 'identified', 'rejected'][CAST(k % 4 + 1 AS INTEGER)] AS action, entity_id AS name FROM obs"}
Q["audit_trail"] = (
    lambda spark, d: g.audit_trail(_audit(spark, d), since=v.WINDOW, name="user_3").select("id", "us", "action"),
    v.sql(f"SELECT id, us, action FROM audit WHERE us >= {v.WINDOW}000000 AND name = 'user_3' ORDER BY us DESC, id DESC LIMIT 100", "obs", ctes=_AUD),
)
Q["audit_counts"] = (lambda spark, d: g.audit_counts(_audit(spark, d)), v.sql("SELECT action, count(*) AS n FROM audit GROUP BY action", "obs", ctes=_AUD))
Q["gallery_counts"] = (
    lambda spark, d: g.gallery_counts(_gallery(spark, d), _audit(spark, d)),
    v.sql("SELECT 'identities' AS \"table\", count(*) AS n FROM gal UNION ALL SELECT 'audit_records', count(*) FROM obs", "obs", ctes=_GAL),
)


def revoked(spark, d):
    left, audit = g.revoke(_gallery(spark, d).withColumn("name", F.col("name").cast("string")), "2", float(v.END))
    rows = left.select(F.lit("kept").alias("action"), "name")
    return rows.unionByName(audit.select("action", "name"))


Q["revoke"] = (revoked, v.sql("SELECT CASE WHEN label = 2 THEN 'revoked' ELSE 'kept' END AS action, CAST(label AS VARCHAR) AS name FROM gal", ctes=_GAL))


def votes(spark, d):
    """A user's events as matches of a track: the name is the event type, one in five unknown."""
    t = v.tracks(spark, d)
    names = F.element_at(F.array(*[F.lit(x) for x in ("ann", "ann", "ann", "bob", "unknown")]), (F.col("k") % 5 + 1).cast("int"))
    m = t.select("source_id", "track_id", F.lit(0).cast("long").alias("island"), (F.col("step") + 1).alias("age"), names.alias("name"), (F.col("k") / 100.0).alias("similarity"))
    return g.vote_identity(m, interval=2, max_attempts=8, reverify=9).select("source_id", "track_id", "age", "action", "name", F.round("similarity", 4).alias("similarity"))


_VOTE = {
    "vm": "SELECT source_id, track_id, step + 1 AS age, ['ann', 'ann', 'ann', 'bob', 'unknown'][CAST(k % 5 + 1 AS INTEGER)] AS name, k / 100.0 AS sim FROM tr",
    "v0": "SELECT *, row_number() OVER (PARTITION BY source_id, track_id ORDER BY age) AS i FROM vm",
    # What each match is used for depends on what came before: nothing, a vote, or a check of the name held.
    "vs": """SELECT DISTINCT source_id, track_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS age, 0 AS ann, 0 AS bob, 0 AS unk, 0 AS tries, '' AS held, CAST(0 AS BIGINT) AS since_,
        '' AS act, '' AS said, 0.0::DOUBLE AS sim FROM v0
        UNION ALL SELECT source_id, track_id, i, age, CASE WHEN breaks THEN 0 ELSE ann + a END, CASE WHEN breaks THEN 0 ELSE bob + b END, CASE WHEN breaks THEN 0 ELSE unk + u END,
        CASE WHEN breaks THEN 0 ELSE tries + t END, CASE WHEN breaks THEN '' WHEN wins THEN name WHEN spent THEN 'unknown' ELSE held END, CASE WHEN wins OR spent THEN age WHEN breaks THEN 0 ELSE since_ END,
        CASE WHEN breaks THEN 'rejected' WHEN wins AND name <> 'unknown' THEN 'identified' WHEN wins OR spent THEN 'rejected' ELSE '' END,
        CASE WHEN breaks THEN held WHEN wins THEN name WHEN spent THEN 'unknown' ELSE '' END, CASE WHEN spent AND NOT wins THEN 0.0::DOUBLE ELSE sim END
        FROM (SELECT *, t = 1 AND (ann + a) * CAST(name = 'ann' AS INTEGER) + (bob + b) * CAST(name = 'bob' AS INTEGER) + (unk + u) * CAST(name = 'unknown' AS INTEGER) >= 3 AS wins,
        t = 1 AND tries + 1 >= 8 AND NOT ((ann + a) * CAST(name = 'ann' AS INTEGER) + (bob + b) * CAST(name = 'bob' AS INTEGER) + (unk + u) * CAST(name = 'unknown' AS INTEGER) >= 3) AS spent,
        held <> '' AND (age - since_) % 9 = 0 AND name <> held AS breaks FROM (
        SELECT p.source_id, p.track_id, n.i, n.age, p.ann, p.bob, p.unk, p.tries, p.held, p.since_, n.name, CAST(n.sim AS DOUBLE) AS sim,
        CASE WHEN p.held = '' AND n.age % 2 = 0 THEN 1 ELSE 0 END AS t, CASE WHEN p.held = '' AND n.age % 2 = 0 AND n.name = 'ann' THEN 1 ELSE 0 END AS a,
        CASE WHEN p.held = '' AND n.age % 2 = 0 AND n.name = 'bob' THEN 1 ELSE 0 END AS b, CASE WHEN p.held = '' AND n.age % 2 = 0 AND n.name = 'unknown' THEN 1 ELSE 0 END AS u
        FROM vs p JOIN v0 n ON n.source_id = p.source_id AND n.track_id = p.track_id AND n.i = p.i + 1))""",
}
Q["vote_identity"] = (votes, v.sql("SELECT source_id, track_id, age, act AS action, said AS name, round(sim, 4) AS similarity FROM vs WHERE act <> ''", "tr", ctes=_VOTE))

# --- scoring --------------------------------------------------------------------------------


def truth_and_pred(spark, d):
    """Detections as truth; the same boxes moved by the tax, with every box its own object and a shifted id from frame 100 on.

    Supplier and line name an object; of two boxes with one name in a frame the later, by id, is told apart by its rank.
    """
    # Numbered within the frame first, so that its boxes are shuffled by frame, as they are joined.
    order = F.row_number().over(Window.partitionBy("source_id", "frame_index").orderBy("track_id", "line", "det_id"))
    twin = F.col("_n") - F.min("_n").over(Window.partitionBy("source_id", "frame_index", "track_id", "line"))
    det = v.detections(spark, d).withColumn("_n", order).withColumn("object_id", (F.col("track_id") * 8 + F.col("line")) * 100 + twin)
    b, dx = F.col("box"), F.col("tax") * 200
    late = F.when(F.col("frame_index") >= 100, F.col("object_id") + 1_000_000).otherwise(F.col("object_id"))
    pred = det.where("time_since_update <> 1 or frame_index % 7 > 0").select(
        "source_id", "frame_index", late.alias("track_id"), box(b["x1"] + dx, b["y1"], b["x2"] + dx, b["y2"]).alias("box")
    )
    return det.select("source_id", "frame_index", "object_id", "box"), pred


def mot(spark, d):
    truth, pred = truth_and_pred(spark, d)
    out = sc.clear_mot(truth, pred)
    return out.withColumn("total_iou", F.round("total_iou", 4))


Q["clear_mot"] = (mot, None)


def ids(spark, d):
    truth, pred = truth_and_pred(spark, d)
    return sc.idf1(truth, pred, sc.match_truth(truth, pred))


Q["idf1"] = (ids, None)
_TRUTH = {
    "t0": "SELECT source_id, frame_index, track_id AS object_id, det_id, x1, y1, x2, y2, tax, time_since_update FROM det",
}


def found_pairs(spark, d):
    """How often each frame's boxes meet at all: the candidates matching starts from."""
    det = v.detections(spark, d)
    truth = det.select("source_id", "frame_index", F.col("det_id").alias("object_id"), "box")
    b = F.col("box")
    pred = det.select("source_id", "frame_index", F.col("det_id").alias("track_id"), box(b["x1"] + 10, b["y1"], b["x2"] + 10, b["y2"]).alias("box"))
    return sc.overlaps(truth, pred).groupBy("source_id").agg(F.count("*").alias("pairs"), F.round(F.sum("iou"), 3).alias("iou"))


Q["overlaps"] = (
    found_pairs,
    v.sql(
        """SELECT source_id, count(*) AS pairs, round(sum(w * h / (aa + ba - w * h)), 3) AS iou FROM (SELECT a.source_id, least(a.x2, b.x2 + 10) - greatest(a.x1, b.x1 + 10) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
        (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM det a JOIN det b USING (source_id, frame_index)) WHERE w > 0 AND h > 0 GROUP BY source_id""", "det",
    ),
)


def histories(spark, d):
    """Switches and resumptions where every match is known: an object is its supplier, the track changes with the month."""
    det = v.detections(spark, d).groupBy("source_id", "frame_index", F.col("track_id").alias("object_id")).agg(F.min("det_id").alias("m"))
    matches = det.where("m % 3 > 0").select("source_id", "frame_index", "object_id", (F.col("frame_index") % 2).alias("track_id"), F.lit(0.9).alias("iou"))
    out = sc.track_history(det, matches)
    return out.groupBy("source_id").agg(F.count("*").alias("truth"), F.count("track_id").alias("matched"), F.count_if("switch").alias("switches"), F.count_if("resumed").alias("resumed"))


Q["track_history"] = (
    histories,
    v.sql(
        """SELECT source_id, count(*) AS truth, count(t) AS matched, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL AND p <> t) AS switches, count(*) FILTER (t IS NOT NULL AND p IS NOT NULL AND NOT was) AS resumed
        FROM (SELECT *, lag(t IGNORE NULLS) OVER w AS p, lag(t IS NOT NULL) OVER w AS was FROM (SELECT source_id, frame_index, object_id, CASE WHEN m % 3 > 0 THEN frame_index % 2 END AS t
        FROM (SELECT source_id, frame_index, track_id AS object_id, min(det_id) AS m FROM det GROUP BY ALL)) WINDOW w AS (PARTITION BY source_id, object_id ORDER BY frame_index)) GROUP BY source_id""", "det",
    ),
)


def _grid(spark, d):
    """Raw counts per candidate and scenario, made from the detections."""
    det = v.detections(spark, d)
    by = det.groupBy(F.concat(F.lit("p"), F.col("frame_index") % 3).alias("candidate"), F.col("source_id").alias("scenario"))
    n = F.count(F.lit(1))
    return by.agg(
        n.alias("ground_truth"), F.count_if(F.expr("confidence > 0.25")).alias("true_positives"), F.count_if(F.expr("confidence > 0.8")).alias("false_positives"),
        F.count_if(F.expr("confidence <= 0.25")).alias("false_negatives"), F.sum(F.when(F.col("confidence") > 0.25, 0.75).otherwise(0.0)).alias("total_iou"), F.count_if(F.expr("frame_index % 50 = 0")).alias("id_switches"),
        F.count_if(F.expr("frame_index % 60 = 0")).alias("fragmentations"), F.count_distinct("track_id").alias("gt_objects"), F.count_if(F.expr("tax = 0")).alias("mostly_tracked"), F.count_if(F.expr("tax > 0.07")).alias("mostly_lost"),
        F.count_if(F.expr("confidence > 0.3")).alias("idtp"), F.count_if(F.expr("confidence > 0.75")).alias("idfp"), F.count_if(F.expr("confidence <= 0.3")).alias("idfn"),
    )


_RATIO = """sum(ground_truth) AS gt, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(ti) AS ti, sum(sw) AS sw, sum(obj) AS obj, sum(idtp) AS idtp, sum(idfp) AS idfp, sum(idfn) AS idfn"""
_OBJ = "0.6::DOUBLE * (2 * idtp / (2 * idtp + idfp + idfn)) + 0.3::DOUBLE * (1 - (fn + fp + sw) / gt) + 0.1::DOUBLE * (ti / tp) - 0.02::DOUBLE * sw / greatest(1, obj)"
_GRID = {
    "gr": """SELECT 'p' || CAST(frame_index % 3 AS VARCHAR) AS candidate, source_id AS scenario, count(*) AS ground_truth, count(*) FILTER (confidence > 0.25) AS tp, count(*) FILTER (confidence > 0.8) AS fp,
        count(*) FILTER (confidence <= 0.25) AS fn, 0.75::DOUBLE * count(*) FILTER (confidence > 0.25) AS ti, count(*) FILTER (frame_index % 50 = 0) AS sw, count(DISTINCT track_id) AS obj,
        count(*) FILTER (confidence > 0.3) AS idtp, count(*) FILTER (confidence > 0.75) AS idfp, count(*) FILTER (confidence <= 0.3) AS idfn FROM det GROUP BY ALL""",
    "ga": f"SELECT candidate, {_RATIO} FROM gr GROUP BY candidate",
    "gs": f"SELECT candidate, scenario, {_RATIO} FROM gr GROUP BY candidate, scenario",
    "go": f"SELECT candidate, {_OBJ} AS pooled FROM ga",
    "gw": f"SELECT candidate, min({_OBJ}) AS worst FROM gs GROUP BY candidate",
}


def pooled(spark, d):
    out = sc.objective(sc.pool(_grid(spark, d), ["candidate"]))
    return out.select("candidate", *[F.round(c, 6).alias(c) for c in ("mota", "motp", "idf1", "recall", "precision", "objective")])


Q["pool_objective"] = (
    pooled,
    v.sql(
        f"""SELECT candidate, round(1 - (fn + fp + sw) / gt, 6) AS mota, round(ti / tp, 6) AS motp, round(2 * idtp / (2 * idtp + idfp + idfn), 6) AS idf1, round(tp / gt, 6) AS recall,
        round(tp / (tp + fp), 6) AS precision, round({_OBJ}, 6) AS objective FROM ga""", "det", ctes=_GRID,
    ),
)


def worst(spark, d):
    out = sc.worst_case_objective(_grid(spark, d))
    return out.select("candidate", *[F.round(c, 6).alias(c) for c in ("pooled", "worst", "objective")])


Q["worst_case_objective"] = (
    worst, v.sql("SELECT candidate, round(pooled, 6) AS pooled, round(worst, 6) AS worst, round(0.75::DOUBLE * pooled + 0.25::DOUBLE * worst, 6) AS objective FROM go JOIN gw USING (candidate)", "det", ctes=_GRID),
)
_L = ("source_id", "frame_index")


def sets(spark, d):
    det = v.detections(spark, d)
    flagged, planted = det.where("confidence > 0.7").select(*_L).distinct(), det.where("label = 'laptop'").select(*_L).distinct()
    parts = [(n, f(flagged, planted)) for n, f in (("found", sc.found), ("missed", sc.missed), ("false_positive", sc.false_positives))]
    out = [p.withColumn("kind", F.lit(n)) for n, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


Q["found_missed_false"] = (
    sets,
    v.sql(
        """SELECT source_id, frame_index, CASE WHEN f AND p THEN 'found' WHEN p THEN 'missed' ELSE 'false_positive' END AS kind FROM (SELECT source_id, frame_index, bool_or(confidence > 0.7) AS f,
        bool_or(label = 'laptop') AS p FROM det GROUP BY ALL) WHERE f OR p""", "det",
    ),
)


def scripted(spark, d):
    """Activities scored against a script made of the table itself: walking is expected on even steps, running banned."""
    from catalog import scene

    acts = scene._acts(spark, d).select(F.concat("source_id", F.lit(":"), "track_id").alias("scenario"), "step", (F.col("t_us") / 1e6).alias("t_s"), "activity")
    who = settle(v.tracks(spark, d).select(F.concat("source_id", F.lit(":"), "track_id").alias("scenario"), "step"))
    every = who.select("scenario").distinct()
    expected = who.where("step % 2 = 0").withColumn("activity", F.lit("walking"))
    moments = every.select("scenario", F.lit("sitting_down").alias("activity"), F.lit(1.0).alias("boundary_s"))
    out = sc.activity_scores(acts, expected, moments, every.withColumn("activity", F.lit("running")), every)
    return out.select("scenario", "expected_total", "expected_hits", "forbidden_firings", "events_expected", "events_found", "event_duplicates", "passed")


def _scripted_sql() -> str:
    from catalog import scene

    return v.sql(
        """SELECT w.scenario, w.n AS expected_total, coalesce(h, 0) AS expected_hits, coalesce(b, 0) AS forbidden_firings, CAST(1 AS BIGINT) AS events_expected, CASE WHEN e > 0 THEN 1::BIGINT ELSE 0::BIGINT END AS events_found,
        greatest(coalesce(e, 0) - 1, 0) AS event_duplicates, coalesce(h, 0) / w.n >= 0.9 AND coalesce(b, 0) = 0 AND coalesce(e, 0) = 1 AS passed
        FROM (SELECT source_id || ':' || CAST(track_id AS VARCHAR) AS scenario, count(*) FILTER (step % 2 = 0) AS n FROM tr GROUP BY 1) w
        LEFT JOIN (SELECT scenario, count(*) FILTER (activity = 'walking' AND step % 2 = 0) AS h, count(*) FILTER (activity = 'running') AS b FROM sa GROUP BY scenario) USING (scenario)
        LEFT JOIN (SELECT scenario, count(*) AS e FROM (SELECT scenario, step, lag(step) OVER (PARTITION BY scenario ORDER BY step) AS p FROM sa WHERE activity = 'sitting_down') WHERE p IS NULL OR p <> step - 1 GROUP BY scenario) USING (scenario)""",
        "isl", "tr", ctes=scene._POST | {"sa": "SELECT DISTINCT source_id || ':' || CAST(track_id AS VARCHAR) AS scenario, step, activity FROM acts"},
    )


Q["activity_scores"] = (scripted, _scripted_sql())


def staged(spark, d):
    """Near relations scored per camera: the lowest pair of each camera is expected, its highest banned after 1 s."""
    from catalog import scene
    from scenelake.operators import relations as rel
    from scenelake.operators import zones as z

    edges = rel.near_relation(scene._pairs(spark, d)).select(
        F.col("source_id").alias("scenario"), (F.col("t_us") / 1e6).alias("t_s"), "relation", F.col("subject_track").alias("a"), F.col("object_track").alias("b"), F.round("confidence", 5).alias("confidence")
    )
    ends = settle(v.tracks(spark, d).groupBy(F.col("source_id").alias("scenario")).agg(F.min("track_id").alias("lo"), F.max("track_id").alias("hi")))
    near = F.lit("near").alias("relation")
    expected = ends.select("scenario", near, F.col("lo").alias("a"), (F.col("lo") + 4).alias("b"))
    banned = ends.select("scenario", near, (F.col("hi") - 4).alias("a"), F.col("hi").alias("b"))
    zone_events = ends.select("scenario", F.col("lo").alias("track_id"), F.lit("left_half").alias("zone"), F.lit("entered").alias("event"))
    crossings = z.crossings(scene._visits(spark, d)).select(F.col("source_id").alias("scenario"), "track_id", "zone", "event")
    out = sc.spatial_scores(edges, crossings, expected, banned, zone_events, ends.select("scenario", F.lit(1.0).alias("grace_s")))
    return out.withColumn("peak_confidence", F.coalesce("peak_confidence", F.lit(-1.0)))


def _staged_sql() -> str:
    from catalog import scene

    return v.sql(
        """SELECT e.source_id AS scenario, CAST(1 AS BIGINT) AS relations_expected, CASE WHEN fc IS NULL THEN 0::BIGINT ELSE 1::BIGINT END AS relations_found, coalesce(round(fc, 5), -1.0) AS peak_confidence,
        coalesce(b, 0) AS forbidden_firings, CAST(1 AS BIGINT) AS zone_events_expected, CASE WHEN ze > 0 THEN 1::BIGINT ELSE 0::BIGINT END AS zone_events_found, fc IS NOT NULL AND coalesce(b, 0) = 0 AND coalesce(ze, 0) > 0 AS passed
        FROM (SELECT source_id, min(track_id) AS lo, max(track_id) AS hi FROM tr GROUP BY 1) e
        LEFT JOIN (SELECT source_id, low, high, max(greatest(0.15, 1 - least(1, sep / 1.5))) AS fc, count(*) FILTER (t_us >= 1000000) AS late FROM ne WHERE since IS NOT NULL GROUP BY ALL) f ON f.source_id = e.source_id AND f.low = lo AND f.high = lo + 4
        LEFT JOIN (SELECT source_id, low, high, count(*) FILTER (t_us >= 1000000) AS b FROM ne WHERE since IS NOT NULL GROUP BY ALL) g ON g.source_id = e.source_id AND g.low = hi - 4 AND g.high = hi
        LEFT JOIN (SELECT source_id, track_id, count(*) AS ze FROM vis WHERE zone = 'left_half' AND event = 'entered' GROUP BY ALL) h ON h.source_id = e.source_id AND h.track_id = lo""",
        "tr", "isl", ctes=scene._NEAR | scene._VIS,
    )


Q["spatial_scores"] = (staged, _staged_sql())

# --- linking --------------------------------------------------------------------------------


def _steps(spark, d):
    """All detections on a 10-frames-a-second clock, under their own ids; boxes of the same supplier stay in place."""
    det = v.detections(spark, d)
    x = ((F.col("track_id") * 53) % 580 + F.col("frame_index") % 5).cast("double")
    y = ((F.col("track_id") * 29) % 300).cast("double")
    return det.select(
        "source_id", F.floor(F.col("frame_index") / 8).alias("step"), ((F.floor(F.col("frame_index") / 8) + 1) * 100_000).cast("long").alias("t_us"),
        "det_id", box(x, y, x + 50, y + 90).alias("box"), "label", "confidence",
    )


Q["association_candidates"] = (
    lambda spark, d: ln.association_candidates(
        v.detections(spark, d).withColumns({"step": F.col("frame_index"), "t_us": F.col("frame_index") * 100_000})
    ).select("source_id", "step", "det_id", "prev_id", "band", F.round("iou", 6).alias("iou")),
    v.sql(
        """SELECT source_id, step, det_id, prev_id, band, round(iou, 6) AS iou FROM (SELECT a.source_id, b.frame_index AS step, b.det_id, a.det_id AS prev_id, CASE WHEN b.confidence >= 0.3 THEN 'high' ELSE 'low' END AS band,
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) -
        greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) AS iou
        FROM det a JOIN det b ON a.source_id = b.source_id AND b.frame_index = a.frame_index + 1 AND a.label = b.label WHERE a.confidence >= 0.1 AND b.confidence >= 0.1)
        WHERE iou >= CASE WHEN band = 'high' THEN 0.2 ELSE 0.4 END""", "det",
    ),
)
_LINKS = {
    "d": "SELECT source_id, frame_index // 8 AS step, det_id, label, confidence, (track_id * 53) % 580 + frame_index % 5 AS x, (track_id * 29) % 300 AS y FROM det WHERE confidence >= 0.1",
    "dw": "SELECT b.source_id, b.step, b.det_id, a.det_id AS prev_id, b.confidence < 0.3 AS weak, greatest(0, 50 - abs(a.x - b.x)) * greatest(0, 90 - abs(a.y - b.y)) AS both_ FROM d a JOIN d b ON a.source_id = b.source_id AND b.step = a.step + 1 AND a.label = b.label",
    "de": "SELECT *, row_number() OVER (PARTITION BY source_id, step ORDER BY weak, -both_ / (9000.0::DOUBLE - both_), prev_id, det_id) AS i FROM dw WHERE both_ / (9000.0::DOUBLE - both_) >= CASE WHEN weak THEN 0.4 ELSE 0.2 END",
    # Every frame's edges one after the other, best first; an edge is taken if neither of its ends is.
    "dg": """SELECT source_id, step, i, det_id, prev_id, TRUE AS kept, [det_id] AS ds, [prev_id] AS ps FROM de WHERE i = 1
        UNION ALL SELECT n.source_id, n.step, n.i, n.det_id, n.prev_id, NOT (list_contains(p.ds, n.det_id) OR list_contains(p.ps, n.prev_id)),
        CASE WHEN list_contains(p.ds, n.det_id) OR list_contains(p.ps, n.prev_id) THEN p.ds ELSE list_append(p.ds, n.det_id) END,
        CASE WHEN list_contains(p.ds, n.det_id) OR list_contains(p.ps, n.prev_id) THEN p.ps ELSE list_append(p.ps, n.prev_id) END
        FROM dg p JOIN de n ON n.source_id = p.source_id AND n.step = p.step AND n.i = p.i + 1""",
    "dl": "SELECT source_id, step, det_id, prev_id FROM dg WHERE kept",
    # Chains from their heads on, one step per round.
    "dh": """SELECT source_id, step, det_id, step AS head_step, det_id AS head_det_id FROM d WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.source_id = d.source_id AND dl.step = d.step AND dl.det_id = d.det_id)
        UNION ALL SELECT l.source_id, l.step, l.det_id, h.head_step, h.head_det_id FROM dh h JOIN dl l ON l.source_id = h.source_id AND l.step = h.step + 1 AND l.prev_id = h.det_id""",
}


def _paired(spark, d):
    return ln.pair_frames(ln.association_candidates(_steps(spark, d)))


Q["pair_frames"] = (_paired, v.sql("SELECT source_id, step, det_id, prev_id FROM dl", "det", ctes=_LINKS))


def chained(spark, d, steps=ln.SLICE_STEPS):
    nodes = _steps(spark, d).where("confidence >= 0.1").select("source_id", "step", "det_id").join(_paired(spark, d), ["source_id", "step", "det_id"], "left")
    return ln.chain_heads(nodes.withColumn("prev_step", F.when(F.col("prev_id").isNotNull(), F.col("step") - 1)), ["step", "det_id"], ["prev_step", "prev_id"], steps=steps)


Q["chain_heads"] = (chained, v.sql("SELECT source_id, step, det_id, head_step, head_det_id FROM dh", "det", ctes=_LINKS))
Q["chain_heads_narrow"] = (lambda spark, d: chained(spark, d, steps=3), v.sql("SELECT source_id, step, det_id, head_step, head_det_id FROM dh", "det", ctes=_LINKS))
Q["link_tracks"] = (lambda spark, d: ln.link_tracks(_steps(spark, d)).select("source_id", "step", "det_id", "track_id", "entity_id", "hits"), None)
