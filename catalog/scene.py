"""Presence, motion, zones, relations, activities and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as v
from scenelake.operators import activity as a
from scenelake.operators import relations as rel
from scenelake.operators import rules as ru
from scenelake.operators import zones as z
from scenelake.operators.motion import motion_state
from scenelake.operators.presence import elapsed, footage_time, presence_islands
from scenelake.session import settle

Q: dict[str, tuple] = {}
ZONES = [
    z.Zone("left_half", ((0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0))),
    z.Zone("doorway", ((0.35, 0.5), (0.65, 0.5), (0.65, 1.0), (0.35, 1.0)), "entrance"),
    z.Zone("kite", ((0.2, 0.4), (0.5, 0.6), (0.8, 0.4), (0.5, 0.95))),
]
LOITER = a.ActivitySettings(loiter_s=0.9)


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


# --- clocks and presence --------------------------------------------------------------------


def clock(spark, d):
    """One frame per event of a camera, read at the wall clock."""
    o = v.observations(spark, d).select(F.col("camera_id").alias("source_id"), "frame_index", (F.col("us") / 1e6).alias("capture_s"))
    t = footage_time(elapsed(o, max_step_s=600.0), max_step_s=600.0)
    return t.select("source_id", "frame_index", "step", r6("elapsed_s"), "t_us")


Q["footage_time"] = (
    clock,
    v.sql(
        """SELECT camera_id AS source_id, frame_index, row_number() OVER w - 1 AS step, round(e, 6) AS elapsed_s,
        CAST(sum(CAST(round(e * 1000000) AS BIGINT)) OVER w AS BIGINT) AS t_us FROM e WINDOW w AS (PARTITION BY camera_id ORDER BY frame_index)""", "obs",
        ctes={"e": """SELECT camera_id, frame_index, CASE WHEN p IS NULL OR us <= p THEN 1.0::DOUBLE / 30 ELSE least(600.0::DOUBLE, us / 1e6::DOUBLE - p / 1e6::DOUBLE) END AS e FROM (
            SELECT camera_id, frame_index, us, lag(us) OVER (PARTITION BY camera_id ORDER BY frame_index) AS p FROM obs)"""},
    ),
)


def islands(spark, d):
    return presence_islands(v.tracks(spark, d)).select("source_id", "track_id", "step", "island", "island_t", F.coalesce("prev_t", F.lit(-1)).alias("prev_t"), F.coalesce("next_t", F.lit(-1)).alias("next_t"))


Q["presence_islands"] = (
    islands,
    v.sql(
        """SELECT source_id, track_id, step, island, island_t, coalesce(lag(t_us) OVER w, -1) AS prev_t, coalesce(lead(t_us) OVER w, -1) AS next_t
        FROM isl WINDOW w AS (PARTITION BY source_id, track_id, island ORDER BY step)""", "isl",
    ),
)


def _present(spark, d, poses=False):
    """Without keypoints, the widest column by far, unless the poses are read."""
    t = v.tracks(spark, d)
    return presence_islands(t if poses else t.drop("keypoints"))


def _state(spark, d, distance=False, poses=False):
    return motion_state(_present(spark, d, poses), with_distance=distance)


def motion(spark, d):
    m = _state(spark, d, distance=True)
    return m.select("source_id", "track_id", "step", "motion", r6("speed"), r6("dwell_s"), r6("age_s"), r6("distance"), F.round(F.coalesce("bearing_deg", F.lit(-1.0)), 6).alias("bearing_deg"))


# A literal state machine, one step per round of the recursion.
_ACC = {
    "m0": "SELECT *, abs(vx) / 120 AS speed, row_number() OVER (PARTITION BY source_id, track_id, island ORDER BY step) AS i FROM isl",
    "m": """SELECT source_id, track_id, island, step, i, cx, y2, speed, vx, t_us, 'unknown' AS motion, CAST(NULL AS VARCHAR) AS pending, 0 AS pending_us, 100000 AS dwell_us, 100000 AS age_us,
        0.0::DOUBLE AS distance FROM m0 WHERE i = 1
        UNION ALL
        SELECT source_id, track_id, island, step, i, cx, y2, speed, vx, t_us, CASE WHEN commits THEN target ELSE motion END, CASE WHEN commits OR target = motion THEN NULL ELSE target END,
        CASE WHEN commits OR target = motion THEN 0 ELSE pend END, CASE WHEN commits THEN 0 ELSE dwell_us + 100000 END, age,
        distance + CASE WHEN (CASE WHEN commits THEN target ELSE motion END) = 'moving' THEN move ELSE 0 END FROM (
        SELECT *, target <> motion AND pend >= 500000 AS commits FROM (
        SELECT *, CASE WHEN target = motion THEN 0 WHEN pending = target THEN pending_us + 100000 ELSE 0 END AS pend FROM (
        SELECT n.source_id, n.track_id, n.island, n.step, n.i, n.cx, n.y2, n.speed, n.vx, n.t_us, m.motion, m.pending, m.pending_us, m.dwell_us, m.age_us + 100000 AS age, m.distance,
        sqrt((n.cx - m.cx) ** 2 + (n.y2 - m.y2) ** 2) / 120 AS move,
        CASE WHEN m.age_us + 100000 < 300000 THEN 'unknown' WHEN n.speed >= 0.15 THEN 'moving' WHEN n.speed <= 0.08 THEN 'stationary' ELSE m.motion END AS target
        FROM m JOIN m0 n ON n.source_id = m.source_id AND n.track_id = m.track_id AND n.island = m.island AND n.i = m.i + 1)))""",
}
Q["motion_state"] = (
    motion,
    v.sql(
        """SELECT source_id, track_id, step, motion, round(speed, 6) AS speed, round(dwell_us / 1e6::DOUBLE, 6) AS dwell_s, round(age_us / 1e6::DOUBLE, 6) AS age_s,
        round(distance, 6) AS distance, CASE WHEN motion = 'moving' AND vx > 0 THEN 90.0::DOUBLE WHEN motion = 'moving' AND vx < 0 THEN 270.0::DOUBLE ELSE -1.0::DOUBLE END AS bearing_deg FROM m""",
        "isl", ctes=_ACC,
    ),
)

# --- zones ----------------------------------------------------------------------------------


def inside(spark, d):
    return z.zone_join(v.tracks(spark, d), ZONES).select("source_id", "track_id", "step", "zone", "zone_kind")


def _crosses(zone: z.Zone) -> str:
    pts, out = zone.points, []
    for (ax, ay), (bx, by) in zip(pts, [*pts[1:], pts[0]]):
        if ay != by:
            out.append(f"(CASE WHEN (({ay} > y) <> ({by} > y)) AND x < {ax}::DOUBLE + (y - {ay}::DOUBLE) / ({by}::DOUBLE - {ay}::DOUBLE) * ({bx}::DOUBLE - {ax}::DOUBLE) THEN 1 ELSE 0 END)")
    return f"({' + '.join(out)}) % 2 = 1"


_IN = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT *, '{q.name}' AS zone, '{q.kind}' AS zone_kind, {i} AS zone_order, {_crosses(q)} AS inside FROM (SELECT *, cx / 640.0::DOUBLE AS x, y2 / 480.0::DOUBLE AS y FROM isl)"
    for i, q in enumerate(ZONES)
) + ")"
Q["zone_join"] = (inside, v.sql("SELECT source_id, track_id, step, zone, zone_kind FROM zi WHERE inside", "isl", ctes={"zi": _IN}))


def inside_grid(spark, d):
    return z.zone_join(v.tracks(spark, d), z.zone_table(spark, ZONES)).select("source_id", "track_id", "step", "zone", "zone_kind")


Q["zone_join_table"] = (inside_grid, v.sql("SELECT source_id, track_id, step, zone, zone_kind FROM zi WHERE inside", "isl", ctes={"zi": _IN}))


def _visits(spark, d):
    return z.zone_visits(_present(spark, d), ZONES, hold_s=0.3)


def visits(spark, d):
    return _visits(spark, d).select("source_id", "track_id", "step", "zone", F.coalesce("event", F.lit("-")).alias("event"), r6("dwell_s"))


_HOLD = 300000
_VIS = {
    "zi": _IN,
    "zo": "SELECT *, row_number() OVER (PARTITION BY source_id, track_id, island, zone ORDER BY step) AS i FROM zi",
    "zv": f"""SELECT source_id, track_id, island, zone, zone_kind, zone_order, label, entity_id, step, t_us, i, inside, CASE WHEN inside THEN t_us END AS entered, CASE WHEN inside THEN t_us END AS lastin, FALSE AS shown
        FROM zo WHERE i = 1
        UNION ALL
        SELECT n.source_id, n.track_id, n.island, n.zone, n.zone_kind, n.zone_order, n.label, n.entity_id, n.step, n.t_us, n.i, n.inside,
        CASE WHEN n.inside THEN coalesce(p.entered, n.t_us) WHEN p.lastin IS NOT NULL AND n.t_us - p.lastin <= {_HOLD} THEN p.entered END,
        CASE WHEN n.inside THEN n.t_us WHEN p.lastin IS NOT NULL AND n.t_us - p.lastin <= {_HOLD} THEN p.lastin END,
        NOT n.inside AND p.lastin IS NOT NULL AND n.t_us - p.lastin <= {_HOLD}
        FROM zv p JOIN zo n ON n.source_id = p.source_id AND n.track_id = p.track_id AND n.island = p.island AND n.zone = p.zone AND n.i = p.i + 1""",
    "vis": f"""SELECT source_id, track_id, island, step, t_us, zone, zone_kind, zone_order, label, entity_id,
        CASE WHEN NOT inside THEN 'exited' WHEN t_us - entered <= {_HOLD} THEN 'entered' ELSE '-' END AS event, (lastin - entered) / 1e6::DOUBLE AS dwell_s FROM zv WHERE inside OR shown""",
}
Q["zone_visits"] = (visits, v.sql("SELECT source_id, track_id, step, zone, event, round(dwell_s, 6) AS dwell_s FROM vis", "isl", ctes=_VIS))
Q["crossings"] = (
    lambda spark, d: z.crossings(_visits(spark, d)).select("source_id", "track_id", "step", "zone", "event"),
    v.sql("SELECT source_id, track_id, step, zone, event FROM vis WHERE event <> '-'", "isl", ctes=_VIS),
)
Q["zone_occupancy"] = (
    lambda spark, d: z.zone_occupancy(_visits(spark, d)).drop("t_us"),
    v.sql("SELECT source_id, step, zone, count(*) AS entities FROM vis WHERE event <> 'exited' GROUP BY ALL", "isl", ctes=_VIS),
)

# --- relations ------------------------------------------------------------------------------

_PAIRS = {
    "big": "SELECT *, row_number() OVER (PARTITION BY source_id, step ORDER BY 2 * half * 120 DESC, track_id) AS rk FROM tr",
    "pr0": """SELECT a.source_id, a.step, a.t_us, a.track_id AS low, b.track_id AS high, a.entity_id AS low_id, b.entity_id AS high_id, a.label AS low_label, b.label AS high_label,
        a.cx AS lx, a.y2 AS ly, a.half AS lh, b.cx AS hx, b.y2 AS hy, b.half AS hh, a.k AS lk, b.k AS hk, sqrt((a.cx - b.cx) ** 2 + (a.y2 - b.y2) ** 2) / 120 AS sep
        FROM big a JOIN big b ON a.source_id = b.source_id AND a.step = b.step AND a.track_id < b.track_id AND a.rk <= 24 AND b.rk <= 24""",
    "pr1": "SELECT *, step - row_number() OVER (PARTITION BY source_id, low, high ORDER BY step) AS g FROM pr0",
    "pr": "SELECT *, min(step) OVER (PARTITION BY source_id, low, high, g) AS pair_island FROM pr1",
}


def _pairs(spark, d):
    return rel.pair_history(v.tracks(spark, d).drop("keypoints"))


def _state_pairs(spark, d):
    return rel.pair_history(_state(spark, d, poses=True))


def edges(df):
    return df.select("source_id", "step", "subject_track", "object_track", "relation", F.round("distance", 5).alias("distance"), F.round("confidence", 5).alias("confidence"), r6("duration_s"))


def pair_rows(spark, d):
    return _pairs(spark, d).select("source_id", "step", "low", "high", "pair_island", F.round("separation", 5).alias("separation"))


Q["pair_join"] = (pair_rows, v.sql("SELECT source_id, step, low, high, pair_island, round(sep, 5) AS separation FROM pr", "tr", ctes=_PAIRS))

_EDGE = "source_id, step, low AS subject_track, high AS object_track"
_NEAR = _PAIRS | {
    "ne0": "SELECT *, row_number() OVER (PARTITION BY source_id, low, high, pair_island ORDER BY step) AS i FROM pr",
    "ne": """SELECT source_id, low, high, pair_island, step, t_us, i, sep, CASE WHEN sep <= 1.5 THEN t_us END AS since FROM ne0 WHERE i = 1
        UNION ALL SELECT n.source_id, n.low, n.high, n.pair_island, n.step, n.t_us, n.i, n.sep,
        CASE WHEN n.sep <= CASE WHEN p.since IS NULL THEN 1.5::DOUBLE ELSE 1.5::DOUBLE + 0.3::DOUBLE END THEN coalesce(p.since, n.t_us) END
        FROM ne p JOIN ne0 n ON n.source_id = p.source_id AND n.low = p.low AND n.high = p.high AND n.pair_island = p.pair_island AND n.i = p.i + 1""",
}
Q["near_relation"] = (
    lambda spark, d: edges(rel.near_relation(_pairs(spark, d))),
    v.sql(
        f"""SELECT {_EDGE}, 'near' AS relation, round(sep, 5) AS distance, round(greatest(0.15, 1 - least(1, sep / 1.5)), 5) AS confidence, round((t_us - since) / 1e6::DOUBLE, 6) AS duration_s
        FROM ne WHERE since IS NOT NULL""", "tr", ctes=_NEAR,
    ),
)
_RATE = _PAIRS | {
    "cl": """SELECT *, first_value(t_us) OVER w AS t0, first_value(sep) OVER w AS d0 FROM pr
        WINDOW w AS (PARTITION BY source_id, low, high, pair_island ORDER BY t_us RANGE BETWEEN 800000 PRECEDING AND CURRENT ROW)""",
    "rt": "SELECT *, CASE WHEN t_us - t0 >= 400000 THEN (d0 - sep) / ((t_us - t0) / 1e6::DOUBLE) END AS rate FROM cl",
}
Q["closing_rate"] = (
    lambda spark, d: edges(rel.closing_rate(_pairs(spark, d))),
    v.sql(
        f"""SELECT {_EDGE}, CASE WHEN rate > 0 THEN 'approaching' ELSE 'receding' END AS relation, round(sep, 5) AS distance, round(least(1, abs(rate) / 0.75), 5) AS confidence,
        0.8::DOUBLE AS duration_s FROM rt WHERE abs(rate) >= 0.25""", "tr", ctes=_RATE,
    ),
)

TOUCH = rel.RelationSettings(interact_s=0.3)
_TOUCH = _PAIRS | _ACC | {
    "po0": """SELECT pr.*, low_label = 'person' AS lowp, CASE WHEN low_label = 'person' THEN low ELSE high END AS who, CASE WHEN low_label = 'person' THEN high ELSE low END AS what FROM pr WHERE low_label <> high_label""",
    "po1": """SELECT *, CASE WHEN lowp THEN lx ELSE hx END AS px, CASE WHEN lowp THEN ly ELSE hy END AS py, CASE WHEN lowp THEN lk ELSE hk END AS pk,
        CASE WHEN lowp THEN hx ELSE lx END AS ox, CASE WHEN lowp THEN hy ELSE ly END AS oy, CASE WHEN lowp THEN hh ELSE lh END AS oh FROM po0""",
    "po2": """SELECT po1.*, m.motion, pk % 4 = 0 AND px + (pk % 9 - 4) * 10 BETWEEN ox - oh AND ox + oh AND py - 60 + (pk % 5) * 10 BETWEEN oy - 120 AND oy AS reach
        FROM po1 JOIN m ON m.source_id = po1.source_id AND m.track_id = who AND m.step = po1.step""",
    "po3": "SELECT *, reach OR (motion = 'stationary' AND sep <= 0.6) AS ok, row_number() OVER (PARTITION BY source_id, low, high, pair_island ORDER BY step) AS i FROM po2",
    "po": """SELECT source_id, low, high, pair_island, who, what, step, t_us, i, sep, CASE WHEN ok THEN t_us END AS since, ok AND reach AS reached, CAST(NULL AS BIGINT) AS claimed FROM po3 WHERE i = 1
        UNION ALL SELECT source_id, low, high, pair_island, who, what, step, t_us, i, sep, since, reached, CASE WHEN since IS NOT NULL AND t_us - since >= 300000 THEN coalesce(claimed, t_us) END FROM (
        SELECT n.source_id, n.low, n.high, n.pair_island, n.who, n.what, n.step, n.t_us, n.i, n.sep, CASE WHEN n.ok THEN coalesce(p.since, n.t_us) END AS since,
        n.ok AND (n.reach OR (p.since IS NOT NULL AND p.reached)) AS reached, CASE WHEN n.ok THEN p.claimed END AS claimed
        FROM po p JOIN po3 n ON n.source_id = p.source_id AND n.low = p.low AND n.high = p.high AND n.pair_island = p.pair_island AND n.i = p.i + 1)""",
}
_TOUCHED = """SELECT source_id, step, who AS subject_track, what AS object_track, 'interacting_with' AS relation, round(sep, 5) AS distance,
    CASE WHEN reached THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS confidence, round((t_us - claimed) / 1e6::DOUBLE, 6) AS duration_s FROM po WHERE claimed IS NOT NULL"""
Q["interaction"] = (lambda spark, d: edges(rel.interaction(_state_pairs(spark, d), TOUCH)), v.sql(_TOUCHED, "tr", "isl", ctes=_TOUCH))
Q["person_object_pairs"] = (
    lambda spark, d: rel.person_object_pairs(_pairs(spark, d)).select("source_id", "step", F.col("person.track_id").alias("person"), F.col("thing.track_id").alias("thing")),
    v.sql("SELECT source_id, step, CASE WHEN low_label = 'person' THEN low ELSE high END AS person, CASE WHEN low_label = 'person' THEN high ELSE low END AS thing FROM pr WHERE low_label <> high_label", "tr", ctes=_PAIRS),
)


def deduped(spark, d):
    """Each edge twice, once turned round; one survives."""
    e = rel.near_relation(_pairs(spark, d))
    turned = e.withColumns({"subject_track": F.col("object_track"), "object_track": F.col("subject_track")})
    out = rel.dedupe_relations(e.unionByName(turned))
    return out.select("source_id", "step", F.least("subject_track", "object_track").alias("a"), F.greatest("subject_track", "object_track").alias("b"))


Q["dedupe_relations"] = (deduped, v.sql("SELECT source_id, step, low AS a, high AS b FROM ne WHERE since IS NOT NULL", "tr", ctes=_NEAR))


def closest(spark, d):
    return rel.largest_per_frame(v.tracks(spark, d), 6).select("source_id", "step", "track_id", F.col("size_rank").cast("long").alias("size_rank"))


Q["largest_per_frame"] = (closest, v.sql("SELECT source_id, step, track_id, rk AS size_rank FROM big WHERE rk <= 6", "tr", ctes={"big": _PAIRS["big"]}))

# --- activities -----------------------------------------------------------------------------


def act(df):
    return df.select("source_id", "track_id", "step", "activity", r6("confidence"), r6("duration_s"))


_W = "PARTITION BY source_id, track_id, island ORDER BY t_us RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_CONT = _ACC | {
    "st": "SELECT m.*, isl.island_t, isl.entity_id, isl.label, isl.posture, isl.posture_confidence AS pc, isl.arm_raised, isl.arm_confidence FROM m JOIN isl USING (source_id, track_id, step)",
    "w": f"""SELECT st.*, min(t_us) OVER s AS w0, count(*) OVER s AS wn, avg(CASE WHEN speed >= 1.3::DOUBLE * 0.8 THEN 1.0::DOUBLE ELSE 0 END) OVER s AS fast,
        avg(CASE WHEN speed >= 1.3 THEN 1.0::DOUBLE ELSE 0 END) OVER s AS run, avg(CASE WHEN speed >= 0.15 THEN 1.0::DOUBLE ELSE 0 END) OVER s AS walk,
        min(CASE WHEN arm_raised THEN 1 ELSE 0 END) OVER s AS arms, avg(arm_confidence) OVER s AS armc FROM st WINDOW s AS ({_W.format(400000)})""",
    "lo": "SELECT *, speed >= 1.3 AND fast >= 0.6 AS running, wn >= 2 AND t_us - w0 >= 360000 AS enough FROM w",
    "loco": """SELECT *, 'x' AS x, CASE WHEN running THEN 'running' ELSE 'walking' END AS activity, 0.5 * least(1, abs(speed - thr) / thr) + 0.5 * sup AS confidence, dwell_us / 1e6::DOUBLE AS duration_s
        FROM (SELECT *, CASE WHEN running THEN 1.3::DOUBLE ELSE 0.15::DOUBLE END AS thr, CASE WHEN running THEN run ELSE walk END AS sup FROM lo) WHERE motion = 'moving' AND speed >= 0.15 AND enough AND sup >= 0.6""",
    "loit": """SELECT *, 'loitering' AS activity, least(1, 0.5 + 0.5 * ((dwell_us / 1e6::DOUBLE - 0.9::DOUBLE) / 0.9::DOUBLE)) AS confidence, dwell_us / 1e6::DOUBLE AS duration_s FROM lo
        WHERE motion = 'stationary' AND dwell_us / 1e6::DOUBLE >= 0.9""",
    "arm": "SELECT *, 'arm_raised' AS activity, armc AS confidence, (t_us - w0) / 1e6::DOUBLE AS duration_s FROM lo WHERE enough AND arms = 1",
}
_ROW = "source_id, track_id, step, activity, round(confidence, 6) AS confidence, round(duration_s, 6) AS duration_s"
Q["locomotion"] = (lambda spark, d: act(a.locomotion(_state(spark, d))), v.sql(f"SELECT {_ROW} FROM loco", "isl", ctes=_CONT))
Q["loitering"] = (lambda spark, d: act(a.loitering(_state(spark, d), LOITER)), v.sql(f"SELECT {_ROW} FROM loit", "isl", ctes=_CONT))
Q["arm_held"] = (lambda spark, d: act(a.arm_held(_state(spark, d))), v.sql(f"SELECT {_ROW} FROM arm", "isl", ctes=_CONT))

_P = "posture <> 'unknown' AND pc >= 0.25"
_POST = _CONT | {
    "p0": f"""SELECT *, count(*) FILTER ({_P}) OVER p AS pn, avg(pc) FILTER ({_P}) OVER p AS pavg, """
    + ", ".join(f"count(*) FILTER ({_P} AND posture = '{n}') OVER p AS n_{n}, max(CASE WHEN posture = '{n}' THEN t_us END) OVER q AS s_{n}" for n in a.STABLE_POSTURES)
    + f" FROM st WINDOW p AS ({_W.format(600000)}), q AS ({_W.format(2500000)})",
    "p1": "SELECT *, CASE WHEN pn = 0 THEN NULL " + " ".join(f"WHEN n_{n} >= pn * 0.7 THEN '{n}'" for n in a.STABLE_POSTURES) + " END AS lead FROM p0",
    "p2": "SELECT *, last_value(lead IGNORE NULLS) OVER (PARTITION BY source_id, track_id, island ORDER BY step) AS stable FROM p1",
    "p3": "SELECT *, lag(stable) OVER (PARTITION BY source_id, track_id, island ORDER BY step) AS was FROM p2",
    "p4": "SELECT *, t_us - CASE was " + " ".join(f"WHEN '{n}' THEN s_{n}" for n in a.STABLE_POSTURES) + " END AS gap FROM p3 WHERE was IS NOT NULL AND was <> stable",
    "mo": """SELECT *, CASE WHEN stable = 'lying' AND was IN ('standing', 'crouching') THEN CASE WHEN gap <= 1200000 THEN 'falling' END WHEN was = 'standing' AND stable = 'sitting' THEN 'sitting_down'
        WHEN was = 'sitting' AND stable = 'standing' THEN 'standing_up' END AS activity, least(1, pavg) AS confidence FROM p4 WHERE gap <= 2500000""",
    "held": """SELECT r.source_id, r.track_id, r.island, r.step, r.t_us, r.entity_id, r.label, mo.activity, mo.confidence, (r.t_us - mo.t_us) / 1e6::DOUBLE AS duration_s FROM st r JOIN mo
        ON r.source_id = mo.source_id AND r.track_id = mo.track_id AND r.island = mo.island AND r.t_us - mo.t_us BETWEEN 0 AND 1500000 WHERE mo.activity IS NOT NULL""",
    "busy": "SELECT source_id, track_id, island, step, t_us, entity_id, label, activity, confidence, duration_s FROM held"
    + "".join(f" UNION ALL SELECT source_id, track_id, island, step, t_us, entity_id, label, activity, confidence, duration_s FROM {t}" for t in ("loco", "loit", "arm")),
    "acts": """SELECT * FROM busy UNION ALL SELECT source_id, track_id, island, step, t_us, entity_id, label, 'idle', 1.0::DOUBLE, (t_us - island_t) / 1e6::DOUBLE FROM st
        WHERE NOT EXISTS (SELECT 1 FROM busy o WHERE o.source_id = st.source_id AND o.track_id = st.track_id AND o.step = st.step)""",
}
Q["stable_posture"] = (
    lambda spark, d: a.stable_posture(_state(spark, d)).select("source_id", "track_id", "step", F.coalesce("stable", F.lit("-")).alias("stable")),
    v.sql("SELECT source_id, track_id, step, coalesce(stable, '-') AS stable FROM p2", "isl", ctes=_POST),
)
Q["posture_transitions"] = (
    lambda spark, d: a.posture_transitions(a.stable_posture(_state(spark, d))).select("source_id", "track_id", "step", "activity", r6("confidence"), r6("gap_s")),
    v.sql("SELECT source_id, track_id, step, activity, round(confidence, 6) AS confidence, round(gap / 1e6::DOUBLE, 6) AS gap_s FROM mo WHERE activity IS NOT NULL", "isl", ctes=_POST),
)


def held(spark, d):
    s = a.stable_posture(_state(spark, d))
    return act(a.hold_transients(s, a.posture_transitions(s)))


Q["hold_transients"] = (held, v.sql(f"SELECT {_ROW} FROM held", "isl", ctes=_POST))


def _acts(spark, d):
    return a.activities(_state(spark, d), LOITER)


Q["activities"] = (lambda spark, d: act(_acts(spark, d)), v.sql(f"SELECT {_ROW} FROM acts", "isl", ctes=_POST))


def union_and_idle(spark, d):
    """The same rows put together from the single recognisers."""
    m = settle(_state(spark, d))
    s = a.stable_posture(m)
    return act(a.idle_fill(m, a.activities_union(a.locomotion(m), a.loitering(m, LOITER), a.arm_held(m), a.hold_transients(s, a.posture_transitions(s)))))


Q["activities_union_idle_fill"] = (union_and_idle, v.sql(f"SELECT {_ROW} FROM acts", "isl", ctes=_POST))
Q["notable"] = (lambda spark, d: act(a.notable(_acts(spark, d))), v.sql(f"SELECT {_ROW} FROM busy", "isl", ctes=_POST))
Q["primary_activity"] = (
    lambda spark, d: act(a.primary_activity(_acts(spark, d))),
    v.sql(
        f"""SELECT {_ROW} FROM acts QUALIFY row_number() OVER (PARTITION BY source_id, track_id, step ORDER BY activity IN ('sitting_down', 'standing_up', 'falling') DESC,
        activity <> 'idle' DESC, acts.confidence DESC, activity DESC) = 1""", "isl", ctes=_POST,
    ),
)
Q["rising_edges"] = (
    lambda spark, d: a.rising_edges(_acts(spark, d)).select("source_id", "track_id", "step", "activity"),
    v.sql(
        """SELECT source_id, track_id, step, activity FROM (SELECT *, lag(step) OVER (PARTITION BY source_id, track_id, island, activity ORDER BY step) AS p FROM
        (SELECT DISTINCT source_id, track_id, island, step, activity FROM acts)) WHERE p IS NULL OR p <> step - 1""", "isl", ctes=_POST,
    ),
)

# --- rules ----------------------------------------------------------------------------------

RULES = (
    ru.RuleSpec("activity", "fall", "alert", 15.0, activity="falling"),
    ru.RuleSpec("activity", "running", "notice", 0.7, activity="running", min_seconds=0.2),
    ru.RuleSpec("activity", "loiter_door", "notice", 0.5, activity="loitering", zones=("doorway", "kite"), labels=("PERSON",), min_confidence=0.55),
    ru.RuleSpec("zone_entry", severity="info", cooldown_s=2.0),
    ru.RuleSpec("zone_exit", severity="info", cooldown_s=0.0),
    ru.RuleSpec("zone_dwell", "dwell", "notice", 0.4, min_seconds=0.5, labels=("person",)),
    ru.RuleSpec("zone_occupancy", "crowd", "alert", 1.0, zones=("left_half", "doorway"), min_count=3),
)
_ENT = "source_id, step, t_us, island, entity_id"
_RULE_SQL = _POST | _VIS | {
    "ez": "SELECT source_id, track_id, step, list(zone ORDER BY zone_order) AS zs, list(zone ORDER BY zone_order) FILTER (zone IN ('doorway', 'kite')) AS dz FROM vis WHERE event <> 'exited' GROUP BY ALL",
    "az": "SELECT acts.*, coalesce(zs[1], '') AS z1, dz[1] AS z2 FROM acts LEFT JOIN ez USING (source_id, track_id, step)",
    "oc": "SELECT source_id, step, t_us, zone, count(*) AS n FROM vis WHERE event <> 'exited' GROUP BY ALL",
    "cand": f"""SELECT {_ENT}, 'fall' AS rule, 0 AS ord, z1 AS zone, 15000000 AS cd FROM az WHERE activity = 'falling'
        UNION ALL SELECT {_ENT}, 'running', 1, z1, 700000 FROM az WHERE activity = 'running' AND duration_s >= 0.2
        UNION ALL SELECT {_ENT}, 'loiter_door', 2, z2, 500000 FROM az WHERE activity = 'loitering' AND label = 'person' AND confidence >= 0.55 AND z2 IS NOT NULL
        UNION ALL SELECT {_ENT}, 'zone_entry', 3, zone, 2000000 FROM vis WHERE event = 'entered'
        UNION ALL SELECT {_ENT}, 'zone_exit', 4, zone, 0 FROM vis WHERE event = 'exited'
        UNION ALL SELECT {_ENT}, 'dwell', 5, zone, 400000 FROM vis WHERE event <> 'exited' AND dwell_s >= 0.5 AND label = 'person'
        UNION ALL SELECT source_id, step, t_us, -1, '', 'crowd', 6, zone, 1000000 FROM oc WHERE n >= 3 AND zone IN ('left_half', 'doorway')""",
    "c0": "SELECT *, row_number() OVER (PARTITION BY source_id, rule, entity_id, island ORDER BY t_us, ord, zone) AS i FROM cand",
    "db": """SELECT source_id, rule, entity_id, island, step, t_us, zone, i, cd, TRUE AS fired, t_us AS lf FROM c0 WHERE i = 1
        UNION ALL SELECT n.source_id, n.rule, n.entity_id, n.island, n.step, n.t_us, n.zone, n.i, n.cd, n.cd = 0 OR n.t_us - p.lf >= n.cd, CASE WHEN n.cd = 0 OR n.t_us - p.lf >= n.cd THEN n.t_us ELSE p.lf END
        FROM db p JOIN c0 n ON n.source_id = p.source_id AND n.rule = p.rule AND n.entity_id = p.entity_id AND n.island = p.island AND n.i = p.i + 1""",
}


def _inputs(spark, d, rules=RULES):
    """What the rules read; rules on zones alone need no activities."""
    present = _present(spark, d)
    inputs = {"visits": z.zone_visits(present, ZONES, hold_s=0.3)}
    if any(r.type == "activity" for r in rules):
        inputs["activities"] = settle(a.activities(motion_state(present, with_distance=False), LOITER))
    return inputs


def _cand(spark, d):
    return ru.rule_candidates(RULES, **_inputs(spark, d))


def cand(df, *more):
    return df.select("source_id", "rule", F.coalesce("entity_id", F.lit("")).alias("entity_id"), "step", F.coalesce("zone", F.lit("")).alias("zone"), *more)


Q["rule_candidates"] = (lambda spark, d: cand(_cand(spark, d)), v.sql("SELECT source_id, rule, entity_id, step, zone FROM cand", "isl", ctes=_RULE_SQL))
for _name, _rules in {
    "rule_activity": ("fall", "running", "loiter_door"), "rule_zone_entry": ("zone_entry",), "rule_zone_exit": ("zone_exit",), "rule_zone_dwell": ("dwell",), "rule_zone_occupancy": ("crowd",),
}.items():
    def _one(spark, d, keep=_rules):
        picked = [r for r in RULES if r.label in keep]
        return cand(ru.rule_candidates(picked, **_inputs(spark, d, picked)))

    _list = ", ".join(f"'{n}'" for n in _rules)
    Q[_name] = (_one, v.sql(f"SELECT source_id, rule, entity_id, step, zone FROM cand WHERE rule IN ({_list})", "isl", ctes=_RULE_SQL))


def relation_rule(spark, d):
    tracks = _present(spark, d)
    e = ru.with_subject_island(rel.near_relation(rel.pair_history(tracks)), tracks)
    rule = ru.RuleSpec("relation", relation="near", min_confidence=0.5, min_seconds=0.2)
    return ru.rule_candidates([rule], edges=e).select("source_id", "rule", "entity_id", "related_id", "step", "island")


Q["rule_relation"] = (
    relation_rule,
    v.sql(
        """SELECT ne.source_id, 'relation:near' AS rule, s.entity_id, o.entity_id AS related_id, ne.step, s.island FROM ne JOIN isl s ON s.source_id = ne.source_id AND s.track_id = low AND s.step = ne.step
        JOIN isl o ON o.source_id = ne.source_id AND o.track_id = high AND o.step = ne.step
        WHERE since IS NOT NULL AND greatest(0.15, 1 - least(1, sep / 1.5)) >= 0.5 AND t_us_ - since >= 200000""".replace("t_us_", "ne.t_us"), "tr", "isl", ctes=_NEAR,
    ),
)


def fired(spark, d):
    return cand(ru.evaluate_rules(RULES, **_inputs(spark, d)), "fired")


Q["evaluate_rules"] = (fired, v.sql("SELECT source_id, rule, entity_id, step, zone, fired FROM db", "isl", ctes=_RULE_SQL))
Q["rule_stats"] = (
    lambda spark, d: ru.rule_stats(ru.evaluate_rules(RULES, **_inputs(spark, d))),
    v.sql("SELECT rule, count(*) FILTER (fired) AS raised, count(*) FILTER (NOT fired) AS suppressed FROM db GROUP BY rule", "isl", ctes=_RULE_SQL),
)


def alerts_spaced(spark, d):
    """Stored alerts, at most one per camera and rule in three hours."""
    from scenelake.plans.greedy import greedy_spacing

    rows = v.alerts(spark, d).withColumn("gap", F.lit(10_800_000_000).cast("long"))
    return greedy_spacing(rows, ["camera_id", "rule"], "us", "gap", ["id"], width=v.DAY_US).select("camera_id", "rule", "id", "kept")


Q["debounce_alerts"] = (
    alerts_spaced,
    v.sql(
        "SELECT camera_id, rule, id, kept FROM g", "alerts",
        ctes={
            "g0": "SELECT camera_id, rule, id, us, row_number() OVER (PARTITION BY camera_id, rule ORDER BY us, id) AS i FROM alerts",
            "g": """SELECT camera_id, rule, id, us, i, TRUE AS kept, us AS lf FROM g0 WHERE i = 1 UNION ALL SELECT n.camera_id, n.rule, n.id, n.us, n.i, n.us - p.lf >= 10800000000,
                CASE WHEN n.us - p.lf >= 10800000000 THEN n.us ELSE p.lf END FROM g p JOIN g0 n ON n.camera_id = p.camera_id AND n.rule = p.rule AND n.i = p.i + 1""",
        },
    ),
)
Q["highest_severity"] = (
    lambda spark, d: ru.highest_severity(v.alerts(spark, d), ["camera_id", "zone"]),
    v.sql("SELECT camera_id, zone, CASE max(CASE severity WHEN 'alert' THEN 2 WHEN 'notice' THEN 1 ELSE 0 END) WHEN 2 THEN 'alert' WHEN 1 THEN 'notice' ELSE 'info' END AS severity FROM alerts GROUP BY camera_id, zone", "alerts"),
)


def retired(spark, d):
    """Of all entities a camera has seen, those not on its last step."""
    t = v.tracks(spark, d)
    last = t.groupBy("source_id").agg(F.max("step").alias("step"))
    return ru.retired_keys(t.select("source_id", "entity_id").distinct(), t.join(last, ["source_id", "step"], "left_semi")).select("source_id", "entity_id")


Q["retired_keys"] = (
    retired,
    v.sql(
        """SELECT DISTINCT source_id, entity_id FROM tr EXCEPT SELECT source_id, entity_id FROM tr JOIN (SELECT source_id, max(step) AS step FROM tr GROUP BY source_id) USING (source_id, step)""", "tr",
    ),
)
