"""Stored tables, history queries, detections, run statistics, expressions."""

from __future__ import annotations

import uuid


from pyspark.sql import functions as F

from catalog import scene
from catalog import views as v
from scenelake.functions import boxes as bx
from scenelake.functions import keypoints as kp
from scenelake.operators import activity as a
from scenelake.operators import detections as de
from scenelake.operators import history as h
from scenelake.operators import stats as st
from scenelake.operators import zones as z
from scenelake.operators.motion import motion_state
from scenelake.operators.presence import presence_islands
from scenelake.session import settle
from scenelake.operators.relations import near_relation, pair_history
from scenelake.session import shared_folder
from scenelake.sources import store

Q: dict[str, tuple] = {}
LO, MID, HI = v.START, v.WINDOW, v.END


def r6(name: str):
    return F.round(name, 6).alias(name)


# --- sources and sinks ----------------------------------------------------------------------


def _stored(spark, d):
    """The views written as stored tables, in a folder of their own."""
    path = f"{shared_folder(spark)}/store/{uuid.uuid4().hex}"
    store.append_records(v.observations(spark, d).withColumn("activities", F.array().cast("array<string>")), "observations", path)
    alerts = v.alerts(spark, d).withColumns({"evidence": store.parse_evidence(F.col("evidence")), "summary": F.col("rule")})
    store.append_records(alerts, "events", path)
    store.append_records(v.beats(spark, d), "heartbeat", path)
    return path


def read_back(spark, d):
    o = store.read_observations(spark, _stored(spark, d))
    return o.groupBy("camera_id", "entity_type").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("entities"), F.round(F.sum("speed"), 4).alias("speed"))


Q["read_observations"] = (
    read_back,
    v.sql("SELECT camera_id, entity_type, count(*) AS n, count(DISTINCT entity_id) AS entities, round(sum(speed), 4) AS speed FROM obs GROUP BY camera_id, entity_type", "obs"),
)
Q["read_events"] = (
    lambda spark, d: store.read_events(spark, _stored(spark, d)).select("id", "rule", "severity", "zone", F.col("evidence")["k"].alias("k")),
    v.sql("SELECT id, rule, severity, zone, CAST(k AS VARCHAR) AS k FROM alerts", "alerts"),
)
Q["read_heartbeats"] = (
    lambda spark, d: h.time_window(store.read_heartbeats(spark, _stored(spark, d)), MID, HI).groupBy("camera_id").agg(F.count("*").alias("n")),
    v.sql(f"SELECT camera_id, count(*) AS n FROM beats WHERE us >= {MID}000000 AND us < {HI}000000 GROUP BY camera_id", "beats"),
)
Q["list_columns"] = (
    lambda spark, d: v.observations(spark, d)
    .select("id", store.format_list_column(F.when(F.col("k") % 7 > 0, F.col("zones")).otherwise(F.array().cast("array<string>"))).alias("wrapped"))
    .select("id", F.coalesce("wrapped", F.lit("-")).alias("wrapped"), F.size(store.parse_list_column(F.col("wrapped"))).cast("long").alias("n"), F.array_join(store.parse_list_column(F.concat(F.lit(",,"), "wrapped")), "+").alias("parts")),
    v.sql(
        """SELECT id, CASE WHEN k % 7 > 0 THEN ',' || array_to_string(zones, ',') || ',' ELSE '-' END AS wrapped, CASE WHEN k % 7 > 0 THEN len(zones) ELSE 0 END AS n,
        CASE WHEN k % 7 > 0 THEN array_to_string(zones, '+') ELSE '' END AS parts FROM obs""", "obs",
    ),
)


def evidence(spark, d):
    raw = F.when(F.col("k") % 10 == 0, F.concat(F.lit("not json "), "k")).when(F.col("k") % 10 == 1, F.lit(None)).otherwise(F.col("evidence"))
    e = v.alerts(spark, d).select("id", store.parse_evidence(raw).alias("e"))
    return e.select("id", F.coalesce(F.col("e")["k"], F.lit("-")).alias("k"), F.coalesce(F.col("e")["_unparsed"], F.lit("-")).alias("unparsed"))


Q["parse_evidence"] = (
    evidence,
    v.sql(
        """SELECT id, CASE WHEN k % 10 IN (0, 1) THEN '-' ELSE CAST(k AS VARCHAR) END AS k, CASE WHEN k % 10 = 0 THEN 'not json ' || CAST(k AS VARCHAR) ELSE '-' END AS unparsed FROM alerts""", "alerts",
    ),
)


def pruned(spark, d):
    """Observations kept 10 days, heartbeats 10, events 20; what is left afterwards is counted too."""
    path = _stored(spark, d)
    gone = store.prune(spark, path, {"observations": HI - 10.5 * 86400, "heartbeat": HI - 10.5 * 86400, "events": HI - 20.25 * 86400})
    left = [store.read_table(spark, t, path).agg(F.count("*").alias("remaining")).select(F.lit(t).alias("table"), "remaining") for t in ("observations", "heartbeat", "events")]
    return gone.join(left[0].unionByName(left[1]).unionByName(left[2]), "table")


Q["prune"] = (
    pruned,
    v.sql(
        " UNION ALL ".join(
            f"SELECT '{t}' AS \"table\", count(*) FILTER (us < {int(cut)}000000) AS removed, count(*) FILTER (us >= {int(cut)}000000) AS remaining FROM {src}"
            for t, src, cut in (("observations", "obs", HI - 10.5 * 86400), ("heartbeat", "beats", HI - 10.5 * 86400), ("events", "alerts", HI - 20.25 * 86400))
        ),
        "obs", "beats", "alerts",
    ),
)
Q["store_counts"] = (
    lambda spark, d: store.store_counts(v.observations(spark, d), v.alerts(spark, d)),
    v.sql("SELECT (SELECT count(*) FROM alerts) AS events, count(*) AS observations, CAST(floor((max(us) - min(us)) / 1e6) AS BIGINT) AS span_s FROM obs", "obs", "alerts"),
)


def routed(spark, d):
    """One mixed batch, split into its tables by kind."""
    o = v.observations(spark, d).withColumn("activities", F.array().cast("array<string>"))
    path = f"{shared_folder(spark)}/store/{uuid.uuid4().hex}"
    o_cols = [c for c in ("id", "timestamp", "camera_id", "entity_id", "entity_type", "motion", "speed", "zones", "activities", "frame_index")]
    mixed = o.select(F.lit("observations").alias("kind"), F.struct(*o_cols).alias("observations"), F.lit(None).cast("struct<camera_id:string,timestamp:timestamp>").alias("heartbeat"))
    beat = v.beats(spark, d).select(F.lit("heartbeat").alias("kind"), F.lit(None).cast(mixed.schema["observations"].dataType).alias("observations"), F.struct("camera_id", "timestamp").alias("heartbeat"))
    store.route_records(mixed.unionByName(beat), path)
    counts = [store.read_table(spark, t, path).groupBy("camera_id").agg(F.count("*").alias("n")).withColumn("table", F.lit(t)) for t in ("observations", "heartbeat")]
    return counts[0].unionByName(counts[1])


Q["route_records"] = (
    routed,
    v.sql("SELECT camera_id, count(*) AS n, 'observations' AS \"table\" FROM obs GROUP BY camera_id UNION ALL SELECT camera_id, count(*), 'heartbeat' FROM beats GROUP BY camera_id", "obs", "beats"),
)

# --- history --------------------------------------------------------------------------------

Q["query_events"] = (
    lambda spark, d: h.query_events(v.alerts(spark, d), since=LO, until=MID, camera="cam2", rule="click", severity="notice", zone="z3").select("id", "us", "entity_id"),
    v.sql(
        f"""SELECT id, us, entity_id FROM alerts WHERE us >= {LO}000000 AND us <= {MID}000000 AND camera_id = 'cam2' AND rule = 'click' AND severity = 'notice' AND zone = 'z3'
        ORDER BY us DESC, id DESC LIMIT 100""", "alerts",
    ),
)
Q["query_observations"] = (
    lambda spark, d: h.query_observations(v.observations(spark, d), since=LO, until=HI, entity_type="view", zone="z4", limit=250, newest_first=False).select("id", "us", "camera_id"),
    v.sql(f"SELECT id, us, camera_id FROM obs WHERE us >= {LO}000000 AND us <= {HI}000000 AND entity_type = 'view' AND list_contains(zones, 'z4') ORDER BY us, id LIMIT 250", "obs"),
)
Q["timeline"] = (
    lambda spark, d: h.timeline(v.alerts(spark, d), "user_7").select("id", "us", "rule"),
    v.sql("SELECT id, us, rule FROM alerts WHERE entity_id = 'user_7' ORDER BY us, id LIMIT 500", "alerts"),
)
Q["timeline_span"] = (
    lambda spark, d: h.timeline_span(h.timeline(v.alerts(spark, d), "user_7")).withColumn("span_s", F.round("span_s", 3)),
    v.sql("SELECT count(*) AS events, round((max(us) - min(us)) / 1e6::DOUBLE, 3) AS span_s FROM alerts WHERE entity_id = 'user_7'", "alerts"),
)
Q["api_page"] = (
    lambda spark, d: h.api_page(h.query_events(v.alerts(spark, d), limit=10_000), 900).select("id"),
    v.sql("SELECT id FROM alerts ORDER BY us DESC, id DESC LIMIT 500", "alerts"),
)
Q["live_snapshot"] = (
    lambda spark, d: h.live_snapshot(v.observations(spark, d).withColumn("frame_index", F.floor(F.col("us") / 3.6e9).cast("long"))).select("camera_id", "entity_id", "frame_index", "id", "entity_type"),
    v.sql(
        """SELECT camera_id, entity_id, f AS frame_index, max(id) AS id, arg_max(entity_type, us) AS entity_type FROM (SELECT *, us // 3600000000 AS f,
        max(us // 3600000000) OVER (PARTITION BY camera_id) AS mf FROM obs) WHERE f = mf GROUP BY camera_id, entity_id, f""", "obs",
    ),
)
Q["stride_sample"] = (
    lambda spark, d: h.stride_sample(v.detections(spark, d), 15).groupBy("source_id").agg(F.count("*").alias("n"), F.max("frame_index").alias("last")),
    v.sql("SELECT source_id, count(*) AS n, max(frame_index) AS last FROM det WHERE frame_index % 15 = 0 GROUP BY source_id", "det"),
)
Q["step_sample"] = (
    lambda spark, d: h.step_sample(v.detections(spark, d).select("source_id", "frame_index", "det_id"), 15, width=500).select("source_id", "frame_index", "det_id"),
    v.sql("SELECT source_id, frame_index, det_id FROM (SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY frame_index) - 1 AS s FROM det) WHERE s % 15 = 0", "det"),
)
Q["heartbeats"] = (
    lambda spark, d: h.heartbeats(v.observations(spark, d), 7200.0).select("camera_id", F.unix_micros("timestamp").alias("us")),
    v.sql("SELECT camera_id, min(us) AS us FROM obs GROUP BY camera_id, us // 7200000000", "obs"),
)
Q["of_labels"] = (
    lambda spark, d: h.of_labels(v.detections(spark, d), "LAPTOP").select("source_id", "frame_index", "det_id"),
    v.sql("SELECT source_id, frame_index, det_id FROM det WHERE label = 'laptop'", "det"),
)
Q["label_vocabulary"] = (lambda spark, d: h.label_vocabulary(v.detections(spark, d)), v.sql("SELECT DISTINCT label FROM det", "det"))


def assembled(spark, d):
    present = scene._present(spark, d)
    m = settle(motion_state(present, with_distance=False))
    out = h.assemble_observations(
        m, poses=m.select("source_id", "track_id", "step", "posture"), activities=a.activities(m, scene.LOITER), visits=z.zone_visits(present, scene.ZONES, hold_s=0.3),
        names=m.where("track_id % 5 = 0").select("source_id", "track_id", F.concat(F.lit("n"), "track_id").alias("name")).distinct(),
    )
    text = {c: F.coalesce(c, F.lit("-")) for c in ("identity", "posture")} | {c: F.array_join(c, ",") for c in ("zones", "activities")}
    return out.withColumns(text)


Q["assemble_observations"] = (
    assembled,
    v.sql(
        """SELECT m.source_id AS camera_id, isl.entity_id, CASE WHEN m.track_id % 5 = 0 THEN 'n' || CAST(m.track_id AS VARCHAR) ELSE '-' END AS identity, label AS entity_type, motion,
        round(speed, 4) AS speed, CASE WHEN posture = 'unknown' THEN '-' ELSE posture END AS posture, coalesce(zs, '') AS zones, coalesce(az, '') AS activities, step AS frame_index,
        round(age_us / 1e6::DOUBLE, 3) AS elapsed_s FROM m JOIN isl USING (source_id, track_id, step)
        LEFT JOIN (SELECT source_id, track_id, step, string_agg(zone, ',' ORDER BY zone) AS zs FROM vis WHERE event <> 'exited' GROUP BY ALL) USING (source_id, track_id, step)
        LEFT JOIN (SELECT source_id, track_id, step, string_agg(activity, ',' ORDER BY activity) AS az FROM (SELECT DISTINCT source_id, track_id, step, activity FROM acts) WHERE activity <> 'idle' GROUP BY ALL)
        USING (source_id, track_id, step)""",
        "isl", ctes=scene._POST | scene._VIS,
    ),
)


def record(spark, d):
    present = presence_islands(v.tracks(spark, d))
    rec = h.scene_record(z.zone_visits(present, scene.ZONES, hold_s=0.3), near_relation(pair_history(present)))
    return rec.select(
        "source_id", "step", F.coalesce(F.size("nodes"), F.lit(0)).cast("long").alias("nodes"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("edges"),
        F.coalesce(F.element_at("nodes", 1)["entity_id"], F.lit("-")).alias("first_node"), F.coalesce(F.element_at("edges", 1)["subject"], F.lit("-")).alias("first_edge"),
    )


Q["scene_record"] = (
    record,
    v.sql(
        """SELECT source_id, step, coalesce(n, 0) AS nodes, coalesce(e, 0) AS edges, coalesce(fn, '-') AS first_node, coalesce(fe, '-') AS first_edge
        FROM (SELECT source_id, step, count(DISTINCT entity_id) AS n, min(entity_id) AS fn FROM vis GROUP BY ALL)
        FULL JOIN (SELECT source_id, step, count(*) AS e, min(low_id) AS fe FROM ne JOIN (SELECT source_id AS s, track_id AS t, any_value(entity_id) AS low_id FROM tr GROUP BY ALL) ON s = source_id AND t = low
        WHERE since IS NOT NULL GROUP BY ALL) USING (source_id, step)""",
        "tr", "isl", ctes=scene._VIS | scene._NEAR,
    ),
)

# --- detections -----------------------------------------------------------------------------


def box_row(df, *more):
    return df.select("source_id", "frame_index", "det_id", *more)


def geometry(spark, d):
    b = F.col("box")
    other = bx.box(b["x1"] + 5, b["y1"] - F.col("tax") * 100, b["x2"] + 15, b["y2"])
    far = bx.clipped(b, F.lit(400.0), F.lit(300.0))
    kite = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in scene.ZONES[2].points])
    vx, vy = F.col("confidence") * 30 - 12, F.col("tax") * 100 - 4
    return box_row(
        v.detections(spark, d), bx.box_width(b).alias("w"), bx.box_height(b).alias("h"), bx.box_area(b).alias("area"), bx.box_center_x(b).alias("cx"),
        bx.box_bottom_center(b)["y"].alias("foot"), bx.box_xywh(b)["w"].alias("ww"), F.round(bx.iou(b, other), 6).alias("iou"), F.round(bx.ground_distance(b, other), 6).alias("ground"),
        F.round(bx.box_area(far), 6).alias("clipped_area"), F.round(bx.speed_heights(vx, vy, bx.box_height(b)), 6).alias("speed"),
        F.coalesce(F.round(bx.bearing_deg(vx, vy), 5), F.lit(-1.0)).alias("bearing"),
        bx.point_in_polygon(bx.box_center_x(b) / 640, b["y2"] / 480, kite).alias("in_kite"), F.round(bx.polygon_centroid(kite)["y"], 6).alias("kite_y"),
        F.round(bx.margin(F.col("confidence"), 0.3, 0.2), 6).alias("margin"), F.round(bx.tilt_from_vertical(vx, vy), 5).alias("tilt"),
    )


_G = scene._crosses(scene.ZONES[2])
Q["box_expressions"] = (
    geometry,
    v.sql(
        f"""SELECT source_id, frame_index, det_id, w, h, w * h AS area, cx, y2 AS foot, w AS ww, CASE WHEN ih > 0 AND iw > 0 THEN round(iw * ih / (w * h + (w + 10) * (y2 - oy1) - iw * ih), 6) ELSE 0.0 END AS iou,
        round(10 / greatest(1, (h + (y2 - oy1)) / 2), 6) AS ground, round(greatest(0, least(x2, 400) - least(x1, 400)) * greatest(0, least(y2, 300) - least(y1, 300)), 6) AS clipped_area,
        round(sqrt(vx ** 2 + vy ** 2) / greatest(h, 1), 6) AS speed, CASE WHEN vx = 0 AND vy = 0 THEN -1.0 ELSE round((degrees(atan2(vx, -vy)) + 360) % 360, 5) END AS bearing,
        {_G} AS in_kite, round((0.4::DOUBLE + 0.6::DOUBLE + 0.4::DOUBLE + 0.95::DOUBLE) / 4, 6) AS kite_y, round(least(1, greatest(0, abs(confidence - 0.3::DOUBLE) / 0.2::DOUBLE)), 6) AS margin,
        round(degrees(atan2(abs(vx), abs(vy))), 5) AS tilt
        FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, y1 - tax * 100 AS oy1, least(x2, x2 + 15) - greatest(x1, x1 + 5) AS iw, y2 - greatest(y1, y1 - tax * 100) AS ih,
        confidence * 30 - 12 AS vx, tax * 100 - 4 AS vy, (x1 + x2) / 2 / 640.0::DOUBLE AS x, y2 / 480.0::DOUBLE AS y FROM det)""", "det",
    ),
)
Q["above_confidence"] = (
    lambda spark, d: box_row(de.keep_classes(de.above_confidence(v.detections(spark, d), 0.45), ["Person"], ["person", "laptop"])),
    v.sql("SELECT source_id, frame_index, det_id FROM det WHERE confidence >= 0.45 AND label = 'person'", "det"),
)
Q["clip_boxes"] = (
    lambda spark, d: box_row(de.clip_boxes(v.detections(spark, d), 400.0, 300.0), F.col("box.x2").alias("x2"), F.col("box.y2").alias("y2")),
    v.sql("SELECT source_id, frame_index, det_id, least(x2, 400.0) AS x2, least(y2, 300.0) AS y2 FROM det WHERE x1 < 400 AND y1 < 300", "det"),
)
Q["observed_confirmed_coasting"] = (
    lambda spark, d: _states(spark, d),
    v.sql("SELECT source_id, count(*) FILTER (time_since_update = 0) AS observed, count(*) FILTER (time_since_update > 0) AS coasting, count(*) FILTER (state = 'confirmed') AS confirmed FROM det GROUP BY source_id", "det"),
)


def _states(spark, d):
    t = v.detections(spark, d)
    parts = [f(t).groupBy("source_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(n)) for n, f in (("observed", de.observed), ("coasting", de.coasting), ("confirmed", de.confirmed))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source_id").pivot("what", ["observed", "coasting", "confirmed"]).agg(F.first("n"))


Q["top_per_frame"] = (
    lambda spark, d: box_row(de.top_per_frame(v.detections(spark, d), 2)),
    v.sql("SELECT source_id, frame_index, det_id FROM det QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY confidence DESC, det_id) <= 2", "det"),
)


def prompts(spark, d):
    t = v.detections(spark, d)
    out = de.prompt_union({"person": t.where("label = 'person'"), "computer": t.where("label = 'laptop'")}, 3)
    return box_row(out, "prompt")


Q["prompt_union"] = (
    prompts,
    v.sql(
        """SELECT source_id, frame_index, det_id, CASE WHEN label = 'laptop' THEN 'computer' ELSE 'person' END AS prompt FROM det
        QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY confidence DESC, det_id) <= 3""", "det",
    ),
)
Q["largest_region"] = (
    lambda spark, d: box_row(de.largest_region(v.detections(spark, d), ["source_id", "frame_index"])),
    v.sql("SELECT source_id, frame_index, det_id FROM det QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY (x2 - x1) * (y2 - y1) DESC, det_id) = 1", "det"),
)
Q["pose_subjects"] = (
    lambda spark, d: box_row(de.pose_subjects(v.detections(spark, d).withColumn("track_id", F.col("det_id")), 1)),
    v.sql(
        """SELECT source_id, frame_index, det_id FROM det WHERE label = 'person' AND state = 'confirmed' AND time_since_update = 0
        QUALIFY row_number() OVER (PARTITION BY source_id, frame_index ORDER BY (x2 - x1) * (y2 - y1) DESC, det_id) = 1""", "det",
    ),
)
_IOU = """least(a.x2, b.x2) - greatest(a.x1, b.x1) > 0 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0 AND (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) /
    ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > {t}"""
Q["nms"] = (
    lambda spark, d: box_row(de.nms(v.detections(spark, d).withColumn("frame_index", F.floor(F.col("frame_index") / 4)), 0.2)),
    v.sql(
        "SELECT source_id, frame_index, det_id FROM walk WHERE keep",
        "det",
        ctes={
            "n0": "SELECT source_id, frame_index // 4 AS frame_index, det_id, label, x1, y1, x2, y2, confidence FROM det",
            "n1": "SELECT *, row_number() OVER (PARTITION BY source_id, frame_index, label ORDER BY confidence DESC, det_id) AS i FROM n0",
            "hid": f"SELECT a.source_id, a.frame_index, a.label, b.i AS i, list(a.i) AS by_ FROM n1 a JOIN n1 b ON a.source_id = b.source_id AND a.frame_index = b.frame_index AND a.label = b.label AND a.i < b.i WHERE {_IOU.format(t='0.2')} GROUP BY ALL",
            "n2": "SELECT n1.*, coalesce(by_, []) AS by_ FROM n1 LEFT JOIN hid USING (source_id, frame_index, label, i)",
            "walk": """SELECT source_id, frame_index, label, i, det_id, TRUE AS keep, [i] AS kept FROM n2 WHERE i = 1 UNION ALL
                SELECT n.source_id, n.frame_index, n.label, n.i, n.det_id, len(list_intersect(w.kept, n.by_)) = 0, CASE WHEN len(list_intersect(w.kept, n.by_)) = 0 THEN list_append(w.kept, n.i) ELSE w.kept END
                FROM walk w JOIN n2 n ON n.source_id = w.source_id AND n.frame_index = w.frame_index AND n.label = w.label AND n.i = w.i + 1""",
        },
    ),
)


def paths(spark, d):
    t = de.trajectories(presence_islands(v.tracks(spark, d)), 5)
    return t.select("source_id", "track_id", "step", F.size("history").cast("long").alias("n"), r6("path_length"), r6("displacement"))


Q["trajectories"] = (
    paths,
    v.sql(
        """SELECT source_id, track_id, step, len(xs) AS n, round(CASE WHEN len(xs) > 1 THEN list_sum(list_transform(range(2, len(xs) + 1), lambda i: sqrt((xs[i] - xs[i - 1]) ** 2 + (ys[i] - ys[i - 1]) ** 2))) ELSE 0.0 END, 6) AS path_length,
        round(sqrt((xs[-1] - xs[1]) ** 2 + (ys[-1] - ys[1]) ** 2), 6) AS displacement FROM (SELECT source_id, track_id, step, list(cx) OVER w AS xs, list(y2 - 60) OVER w AS ys FROM isl
        WINDOW w AS (PARTITION BY source_id, track_id, island ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))""", "isl",
    ),
)

# --- statistics -----------------------------------------------------------------------------


def tallies(spark, d):
    o = v.observations(spark, d)
    parts = [st.tally(o, c).select(F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit("-")).alias("which"), "n") for c in ("motion", "entity_type", "camera_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


Q["tally"] = (
    tallies,
    v.sql(" UNION ALL ".join(f"SELECT '{c}' AS what, coalesce({c}, '-') AS which, count(*) AS n FROM obs GROUP BY {c}" for c in ("motion", "entity_type", "camera_id")), "obs"),
)
Q["majority_class"] = (
    lambda spark, d: st.majority_class(v.observations(spark, d).select(F.col("camera_id").alias("source_id"), F.col("user_id").alias("track_id"), F.col("entity_type").alias("label"), "frame_index")),
    v.sql(
        """SELECT camera_id AS source_id, user_id AS track_id, entity_type AS label, n AS votes FROM (SELECT camera_id, user_id, entity_type, count(*) AS n, min(frame_index) AS f FROM obs GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY camera_id, user_id ORDER BY n DESC, f) = 1""", "obs",
    ),
)
Q["latency_summary"] = (
    lambda spark, d: st.latency_summary(v.observations(spark, d).select(F.col("entity_type").alias("stage"), F.col("id").alias("seq"), F.col("value").alias("ms"))).withColumn("mean_ms", F.round("mean_ms", 6)),
    v.sql(
        """SELECT t.stage, samples, last_ms, round(mean_ms, 6) AS mean_ms, max_ms, w[CAST(greatest(1, round_even(0.5 * len(w), 0)) AS INTEGER)] AS p50_ms, w[CAST(greatest(1, round_even(0.95 * len(w), 0)) AS INTEGER)] AS p95_ms
        FROM (SELECT entity_type AS stage, count(*) AS samples, arg_max(value, id) AS last_ms, avg(value) AS mean_ms, max(value) AS max_ms FROM obs GROUP BY 1) t
        JOIN (SELECT entity_type AS stage, list(value ORDER BY value) AS w FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY id DESC) AS r FROM obs) WHERE r <= 240 GROUP BY 1) q USING (stage)""", "obs",
    ),
)
Q["rate_summary"] = (
    lambda spark, d: st.rate_summary(v.observations(spark, d).select(F.col("camera_id").alias("source_id"), F.col("us").alias("t_us"))).select(
        "source_id", "ticks", F.round("elapsed_s", 3).alias("elapsed_s"), F.round("mean_rate", 9).alias("mean_rate"), F.round("rate", 9).alias("rate")
    ),
    v.sql(
        """SELECT source_id, ticks, elapsed_s, mean_rate, round(1000000 / s, 9) AS rate FROM (SELECT camera_id AS source_id, count(*) AS ticks, round((max(us) - min(us)) / 1e6::DOUBLE, 3) AS elapsed_s,
        round((count(*) - 1) / ((max(us) - min(us)) / 1e6::DOUBLE), 9) AS mean_rate FROM obs GROUP BY 1) JOIN (SELECT camera_id AS source_id, arg_max(s, i) AS s FROM ew GROUP BY 1) USING (source_id)""",
        "obs",
        ctes={
            "iv": "SELECT camera_id, us - p AS g, row_number() OVER (PARTITION BY camera_id ORDER BY us) AS i FROM (SELECT camera_id, us, lag(us) OVER (PARTITION BY camera_id ORDER BY us) AS p FROM obs) WHERE us > p",
            "ew": "SELECT camera_id, i, CAST(g AS DOUBLE) AS s FROM iv WHERE i = 1 UNION ALL SELECT n.camera_id, n.i, 0.15::DOUBLE * n.g + (1 - 0.15::DOUBLE) * e.s FROM ew e JOIN iv n ON n.camera_id = e.camera_id AND n.i = e.i + 1",
        },
    ),
)


def health(spark, d):
    log = v.observations(spark, d).select(
        F.col("entity_type").alias("stage"), F.col("id").alias("seq"),
        F.when(F.col("value") >= 100, "Timeout").when(F.col("value") >= 60, "ValueError").alias("error_type"),
    )
    out = st.stage_health(log)
    return out.select("stage", "calls", "failures", r6("failure_rate"), F.col("worst_streak").cast("long").alias("worst_streak"), "disabled", F.col("error_types")["Timeout"].alias("timeouts"))


Q["stage_health"] = (
    health,
    v.sql(
        """SELECT stage, count(*) AS calls, count(*) FILTER (bad) AS failures, round(count(*) FILTER (bad) / count(*), 6) AS failure_rate, coalesce(max(n) FILTER (bad), 0) AS worst_streak,
        coalesce(max(n) FILTER (bad), 0) >= 5 AS disabled, count(*) FILTER (value >= 100) AS timeouts FROM (SELECT *, count(*) OVER (PARTITION BY stage, bad, g) AS n FROM (
        SELECT entity_type AS stage, value, value >= 60 AS bad, row_number() OVER (PARTITION BY entity_type ORDER BY id) - row_number() OVER (PARTITION BY entity_type, value >= 60 ORDER BY id) AS g FROM obs)) GROUP BY stage""", "obs",
    ),
)
Q["drop_report"] = (
    lambda spark, d: st.drop_report(v.observations(spark, d).select(F.col("camera_id").alias("source_id"), "frame_index")).withColumn("drop_rate", F.round("drop_rate", 6)),
    v.sql(
        """SELECT camera_id AS source_id, count(DISTINCT frame_index) AS delivered, max(frame_index) - min(frame_index) + 1 - count(DISTINCT frame_index) AS dropped,
        round((max(frame_index) - min(frame_index) + 1 - count(DISTINCT frame_index)) / (max(frame_index) - min(frame_index) + 1), 6) AS drop_rate FROM obs GROUP BY 1""", "obs",
    ),
)
Q["track_lifetimes"] = (
    lambda spark, d: st.track_lifetimes(v.detections(spark, d)),
    v.sql(
        """SELECT source_id, track_id, min(frame_index) AS first_frame, max(frame_index) AS last_frame, max(frame_index) - min(frame_index) + 1 AS duration_frames,
        count(*) FILTER (time_since_update = 0) AS hits FROM det GROUP BY source_id, track_id""", "det",
    ),
)
Q["pose_coverage"] = (
    lambda spark, d: st.pose_coverage(v.detections(spark, d), v.detections(spark, d).where("state = 'confirmed' and confidence >= 0.4")),
    v.sql(
        """SELECT source_id, frame_index, count(*) AS people, count(*) FILTER (state = 'confirmed' AND confidence >= 0.4) AS posed,
        count(*) - count(*) FILTER (state = 'confirmed' AND confidence >= 0.4) AS skipped FROM det GROUP BY source_id, frame_index""", "det",
    ),
)

# --- keypoints ------------------------------------------------------------------------------


def keypoint_row(spark, d):
    p = v.poses(spark, d)
    k, b = F.col("keypoints"), F.col("box")
    mid = kp.keypoint_mid(kp.seen(k, 5, 0.3), kp.seen(k, 6, 0.3))
    return p.select(
        "vec_id", kp.visible_count(k, 0.5).cast("long").alias("visible"), F.round(kp.pose_confidence(k), 6).alias("mean_confidence"),
        F.size(kp.drop_face_keypoints(k)).cast("long").alias("body"), F.round(kp.arm_confidence(k), 6).alias("arm"), kp.wrist_inside(k, b).alias("wrist_inside"),
        (kp.arm_confidence(kp.drop_face_keypoints(k)) == kp.arm_confidence(k)).alias("same_without_face"), F.coalesce(F.round(mid["x"], 4), F.lit(-1.0)).alias("shoulder_x"),
    )


def _kpt(i: int) -> str:
    return f"kps[{i + 1}]"


def _arm(w: int, s: int) -> str:
    return f"CASE WHEN {_kpt(w)}.c >= 0.3 AND {_kpt(s)}.c >= 0.3 AND {_kpt(w)}.y < {_kpt(s)}.y THEN least({_kpt(w)}.c, {_kpt(s)}.c) ELSE 0.0 END"


def _touch(w: int) -> str:
    return f"({_kpt(w)}.c >= 0.35 AND {_kpt(w)}.x BETWEEN 200 AND 400 AND {_kpt(w)}.y BETWEEN 100 AND 300)"


def _mid(l: int, r: int, f: str, t: float = 0.3) -> str:
    both = f"least({_kpt(l)}.c, {_kpt(r)}.c)" if f == "c" else f"({_kpt(l)}.{f} + {_kpt(r)}.{f}) / 2"
    return f"CASE WHEN {_kpt(l)}.c >= {t} AND {_kpt(r)}.c >= {t} THEN {both} WHEN {_kpt(l)}.c >= {t} THEN {_kpt(l)}.{f} WHEN {_kpt(r)}.c >= {t} THEN {_kpt(r)}.{f} END"


Q["keypoint_expressions"] = (
    keypoint_row,
    v.sql(
        f"""SELECT vec_id, len(list_filter(kps, lambda p: p.c >= 0.5)) AS visible, round(list_sum(list_transform(kps, lambda p: p.c)) / 17, 6) AS mean_confidence, CAST(12 AS BIGINT) AS body,
        round(greatest({_arm(9, 5)}, {_arm(10, 6)}), 6) AS arm, {_touch(9)} OR {_touch(10)} AS wrist_inside, TRUE AS same_without_face, coalesce(round({_mid(5, 6, 'x')}, 4), -1.0) AS shoulder_x FROM poses""",
        "poses",
    ),
)


def postures(spark, d):
    # Hips and shoulders are raised and lowered by id so that every branch is met.
    p = v.poses(spark, d)
    i = F.col("vec_id")
    lift = F.transform("keypoints", lambda k, n: F.struct(
        k["x"].alias("x"),
        (k["y"] + F.when(n >= 15, (i % 3) * 90).when(n >= 13, (i % 5) * 50).when(n >= 11, F.lit(60)).otherwise(0)).alias("y"),
        F.greatest(k["confidence"], F.when(i % 4 > 0, 0.6).otherwise(0.0)).alias("confidence"),
    ))
    out = kp.with_posture(p.select("vec_id", lift.alias("keypoints"), "box"))
    return out.select("vec_id", "posture", F.round("posture_confidence", 6).alias("confidence"), F.col("posture_reason").alias("reason"))


_PO = {
    "po0": """SELECT vec_id, list_transform(range(17), lambda n: {'x': kps[n + 1].x, 'y': kps[n + 1].y + CASE WHEN n >= 15 THEN (vec_id % 3) * 90 WHEN n >= 13 THEN (vec_id % 5) * 50 WHEN n >= 11 THEN 60 ELSE 0 END,
        'c': greatest(kps[n + 1].c, CASE WHEN vec_id % 4 > 0 THEN 0.6 ELSE 0.0 END)}) AS kps FROM poses""",
    "po1": "SELECT vec_id, " + ", ".join(f"{_mid(l, r, f)} AS {n}{f}" for n, l, r in (("s", 5, 6), ("h", 11, 12), ("k", 13, 14), ("a", 15, 16)) for f in ("x", "y", "c")) + " FROM po0",
    "po2": "SELECT *, sqrt((hx - sx) ** 2 + (hy - sy) ** 2) AS torso, degrees(atan2(abs(hx - sx), abs(hy - sy))) AS tilt, least(sc, hc) AS sure FROM po1",
    "po3": "SELECT *, (ky - hy) / torso AS thigh, (ay - ky) / torso AS shank FROM po2",
}
_MG = "greatest(0, least(1, abs({} - {}) / {}))"
Q["classify_posture"] = (
    postures,
    v.sql(
        f"""SELECT vec_id, r[1] AS posture, round(CASE r[1] WHEN 'lying' THEN sure * {_MG.format('tilt', 55, '25.0::DOUBLE')} WHEN 'standing' THEN least(sure, kc) * {_MG.format('thigh', '0.55::DOUBLE', '0.35::DOUBLE')}
        WHEN 'sitting' THEN least(sure, kc, ac) * {_MG.format('shank', '0.55::DOUBLE', '0.35::DOUBLE')} WHEN 'crouching' THEN least(sure, kc, ac) * {_MG.format('shank', '0.55::DOUBLE', '0.35::DOUBLE')} ELSE 0.0 END, 6) AS confidence,
        r[2] AS reason FROM (SELECT *, CASE WHEN sx IS NULL OR hx IS NULL THEN ['unknown', 'torso_missing'] WHEN torso < 0.12 * 200 THEN ['unknown', 'foreshortened'] WHEN tilt >= 55 THEN ['lying', 'tilted']
        WHEN kx IS NULL THEN ['unknown', 'no_knees'] WHEN thigh >= 0.55 THEN ['standing', 'legs_extended'] WHEN ax IS NULL THEN ['unknown', 'no_ankles'] WHEN shank >= 0.55 THEN ['sitting', 'shank_extended']
        ELSE ['crouching', 'folded'] END AS r FROM po3)""", "poses", ctes=_PO,
    ),
)
