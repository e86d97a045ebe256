"""The driver tables seen as observations, alerts, detections, tracks: once in Spark, once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.functions.boxes import box
from scenelake.operators.presence import step_ordinal

DAY_US = 86_400_000_000
START, WINDOW, END = 1_704_067_200, 1_706_054_400, 1_706_659_200
"""2024-01-01, 2024-01-24 and 2024-01-31, midnight UTC: history, window start, window end."""

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.schema(EVENTS).parquet(f"{d}/events.parquet")
    return e.withColumns({"k": F.regexp_extract("props", "([0-9]+)", 1).cast("long"), "us": F.unix_micros("ts")})


def text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def observations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, d).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        "us",
        text("cam", F.col("user_id") % 4).alias("camera_id"),
        text("user_", F.col("user_id")).alias("entity_id"),
        F.col("event_type").alias("entity_type"),
        F.when(F.col("value") >= 50, "moving").when(F.col("value") <= 20, "stationary").alias("motion"),
        F.when(F.col("event_type") != "error", F.col("value") / 50.0).alias("speed"),
        F.when(k % 2 == 0, F.array(text("z", k % 8), text("z", k % 5))).otherwise(F.array(text("z", k % 8))).alias("zones"),
        F.col("event_id").alias("frame_index"),
        "k",
        "value",
        "user_id",
    )


def sparse(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).where("entity_type = 'purchase' and k % 3 = 0")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        "us",
        text("cam", F.col("user_id") % 4).alias("camera_id"),
        F.col("event_type").alias("rule"),
        F.when(F.col("value") >= 100, "alert").when(F.col("value") >= 40, "notice").otherwise("info").alias("severity"),
        text("user_", F.col("user_id")).alias("entity_id"),
        text("z", F.col("k") % 8).alias("zone"),
        F.col("event_id").alias("frame_index"),
        F.col("props").alias("evidence"),
        "k",
    )


def beats(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d).where("entity_type = 'view'")
    return rows.where("date(timestamp) <> date'2024-01-20'").select("camera_id", "timestamp", "us")


LINEITEM = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def detections(spark: SparkSession, d: str) -> DataFrame:
    """About four boxes per frame. The id is a hash of all of the row's columns, so no row is lost to another."""
    li = spark.read.schema(LINEITEM).parquet(f"{d}/lineitem.parquet")
    whole = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")] + [F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    x1 = ((F.col("l_partkey") * 37) % 580).cast("double")
    y1 = ((F.col("l_suppkey") * 53) % 380).cast("double")
    q = F.col("l_quantity")
    return li.select(
        text("cam", F.col("l_orderkey") % 8).alias("source_id"),
        F.floor(F.col("l_orderkey") / 8).alias("frame_index"),
        F.conv(F.substring(F.md5(F.concat_ws(":", *whole, "l_returnflag", F.unix_seconds("l_shipdate").cast("string"))), 1, 13), 16, 10).cast("long").alias("det_id"),
        box(x1, y1, x1 + 20 + q, y1 + 40 + 2 * q).alias("box"),
        F.when(F.col("l_returnflag") == "A", "laptop").otherwise("person").alias("label"),
        (0.1 + 8 * F.col("l_discount")).alias("confidence"),
        F.col("l_tax").alias("tax"),
        (F.col("l_orderkey") % 3).alias("time_since_update"),
        F.when(F.col("l_linenumber") % 3 == 0, "tentative").otherwise("confirmed").alias("state"),
        F.col("l_suppkey").alias("track_id"),
        F.col("l_linenumber").cast("long").alias("line"),
    )


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Ten frames a second; a user's n-th event is its box on frame n of its camera, one in ten missing."""
    e = step_ordinal(_events(spark, d), ["user_id"], ["us", "event_id"], "q", width=DAY_US)
    e = e.where("k % 10 <> 0")
    u, q, k = F.col("user_id"), F.col("q"), F.col("k")
    pace = F.element_at(F.array(*[F.lit(v) for v in (0.0, 0.1, 0.8, 2.0)]), ((F.floor(q / 9) + u) % 4 + 1).cast("int"))
    posture = F.element_at(
        F.array(*[F.lit(v) for v in ("standing", "standing", "sitting", "lying", "crouching")]), ((F.floor(q / 12) + u) % 5 + 1).cast("int")
    )
    cx = ((u * 37) % 500 + (u % 5) * 3 * F.abs(q % 20 - 10)).cast("double")
    y2 = (200 + (u * 13) % 200 + (q % 10) * 5).cast("double")
    half = (40 + u % 30) / 2.0
    label = F.when(u % 3 == 0, "laptop").otherwise("person")
    blank = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("confidence"))
    wrist = F.struct(
        (cx + (k % 9 - 4) * 10).alias("x"), (y2 - 60 + (k % 5) * 10).alias("y"), F.when(k % 4 == 0, 0.9).otherwise(0.1).alias("confidence")
    )
    return e.select(
        text("cam", u % 4).alias("source_id"),
        u.alias("track_id"),
        q.alias("step"),
        q.alias("frame_index"),
        F.lit(100_000).cast("long").alias("elapsed_us"),
        ((q + 1) * 100_000).alias("t_us"),
        text(label, "_", u).alias("entity_id"),
        label.alias("label"),
        box(cx - half, y2 - 120, cx + half, y2).alias("box"),
        (pace * 120 + (k % 7 - 3) * 0.5).alias("vx"),
        F.lit(0.0).alias("vy"),
        F.when(k % 9 == 0, "unknown").otherwise(posture).alias("posture"),
        (0.3 + (k % 60) / 100.0).alias("posture_confidence"),
        ((F.floor(q / 6) + u) % 3 == 0).alias("arm_raised"),
        (0.5 + (k % 40) / 100.0).alias("arm_confidence"),
        F.array(*[blank] * 9, wrist, *[blank] * 7).alias("keypoints"),
        "k",
    )


def poses(spark: SparkSession, d: str) -> DataFrame:
    """A 17-point skeleton per vector."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    v = lambda i: F.element_at("embedding", i).cast("double")
    kps = F.transform(
        F.sequence(F.lit(0), F.lit(16)),
        lambda i: F.struct(
            (300 + 200 * v(3 * i + 1)).alias("x"), (200 + 200 * v(3 * i + 2)).alias("y"), F.least(F.lit(1.0), F.abs(8 * v(3 * i + 3))).alias("confidence")
        ),
    )
    return e.select("vec_id", "label", kps.alias("keypoints"), box(F.lit(200.0), F.lit(100.0), F.lit(400.0), F.lit(300.0)).alias("box"))


SQL = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, epoch_us(ts) AS us FROM events",
    "obs": """SELECT event_id AS id, ts AS timestamp, us, 'cam' || CAST(user_id % 4 AS VARCHAR) AS camera_id,
        'user_' || CAST(user_id AS VARCHAR) AS entity_id, event_type AS entity_type,
        CASE WHEN value >= 50 THEN 'moving' WHEN value <= 20 THEN 'stationary' END AS motion,
        CASE WHEN event_type <> 'error' THEN value / 50.0 END AS speed,
        CASE WHEN k % 2 = 0 THEN ['z' || CAST(k % 8 AS VARCHAR), 'z' || CAST(k % 5 AS VARCHAR)] ELSE ['z' || CAST(k % 8 AS VARCHAR)] END AS zones,
        event_id AS frame_index, k, value, user_id FROM ev""",
    "sparse": "SELECT * FROM obs WHERE entity_type = 'purchase' AND k % 3 = 0",
    "alerts": """SELECT event_id AS id, us, 'cam' || CAST(user_id % 4 AS VARCHAR) AS camera_id, event_type AS rule,
        CASE WHEN value >= 100 THEN 'alert' WHEN value >= 40 THEN 'notice' ELSE 'info' END AS severity,
        'user_' || CAST(user_id AS VARCHAR) AS entity_id, 'z' || CAST(k % 8 AS VARCHAR) AS zone, event_id AS frame_index, props AS evidence, k FROM ev""",
    "beats": "SELECT camera_id, us FROM obs WHERE entity_type = 'view' AND CAST(timestamp AS DATE) <> DATE '2024-01-20'",
    "det": """SELECT source_id, frame_index, det_id, x1, y1, x1 + 20 + qty AS x2, y1 + 40 + 2 * qty AS y2, label, confidence, tax, time_since_update, state, track_id, line
        FROM (SELECT 'cam' || CAST(l_orderkey % 8 AS VARCHAR) AS source_id, l_orderkey // 8 AS frame_index,
            ('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity * 100) AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT),
                CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), l_returnflag, CAST(floor(epoch(l_shipdate)) AS BIGINT))), 1, 13))::BIGINT AS det_id,
            CAST((l_partkey * 37) % 580 AS DOUBLE) AS x1, CAST((l_suppkey * 53) % 380 AS DOUBLE) AS y1, l_quantity AS qty,
            CASE WHEN l_returnflag = 'A' THEN 'laptop' ELSE 'person' END AS label, 0.1::DOUBLE + 8 * l_discount AS confidence, l_tax AS tax,
            l_orderkey % 3 AS time_since_update, CASE WHEN l_linenumber % 3 = 0 THEN 'tentative' ELSE 'confirmed' END AS state, l_suppkey AS track_id, CAST(l_linenumber AS BIGINT) AS line
            FROM lineitem)""",
    "tr0": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS q FROM ev",
    "tr": """SELECT 'cam' || CAST(user_id % 4 AS VARCHAR) AS source_id, user_id AS track_id, q AS step, (q + 1) * 100000 AS t_us,
        CASE WHEN user_id % 3 = 0 THEN 'laptop' ELSE 'person' END AS label,
        CASE WHEN user_id % 3 = 0 THEN 'laptop_' ELSE 'person_' END || CAST(user_id AS VARCHAR) AS entity_id,
        CAST((user_id * 37) % 500 + (user_id % 5) * 3 * abs(q % 20 - 10) AS DOUBLE) AS cx, CAST(200 + (user_id * 13) % 200 + (q % 10) * 5 AS DOUBLE) AS y2,
        (40 + user_id % 30) / 2.0 AS half,
        [0.0::DOUBLE, 0.1::DOUBLE, 0.8::DOUBLE, 2.0::DOUBLE][CAST((q // 9 + user_id) % 4 + 1 AS INTEGER)] * 120 + (k % 7 - 3) * 0.5::DOUBLE AS vx,
        CASE WHEN k % 9 = 0 THEN 'unknown' ELSE ['standing', 'standing', 'sitting', 'lying', 'crouching'][CAST((q // 12 + user_id) % 5 + 1 AS INTEGER)] END AS posture,
        0.3::DOUBLE + (k % 60) / 100.0 AS posture_confidence, (q // 6 + user_id) % 3 = 0 AS arm_raised, 0.5::DOUBLE + (k % 40) / 100.0 AS arm_confidence, k
        FROM tr0 WHERE k % 10 <> 0""",
    "trg": "SELECT *, step - row_number() OVER (PARTITION BY source_id, track_id ORDER BY step) AS g FROM tr",
    "isl": """SELECT *, min(step) OVER (PARTITION BY source_id, track_id, g) AS island, min(t_us) OVER (PARTITION BY source_id, track_id, g) AS island_t FROM trg""",
    "poses": """SELECT vec_id, label, list_transform(range(17), lambda i: {'x': 300 + 200 * CAST(embedding[3 * i + 1] AS DOUBLE), 'y': 200 + 200 * CAST(embedding[3 * i + 2] AS DOUBLE),
        'c': least(1.0, abs(8 * CAST(embedding[3 * i + 3] AS DOUBLE)))}) AS kps FROM embeddings""",
}
NEEDS = {
    "obs": ["ev"], "sparse": ["obs"], "alerts": ["ev"], "beats": ["obs"], "tr0": ["ev"], "tr": ["tr0"], "trg": ["tr"], "isl": ["trg"],
}


def sql(body: str, *views: str, ctes: dict[str, str] | None = None) -> str:
    """A statement over the named views; extra ``ctes`` come after them, in order."""
    order: list[str] = []

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    parts = [f"{v} AS ({SQL[v]})" for v in order] + [f"{n} AS ({t})" for n, t in (ctes or {}).items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
