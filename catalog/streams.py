"""Streaming operators, replayed over the whole tables in shuffled micro-batches, against the SQL of the batch ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog import scene
from catalog import views as v
from scenelake.operators import relations as rel
from scenelake.operators import zones
from scenelake.sources import store
from scenelake.session import settle, shared_folder
from scenelake.streaming import stateful as st
from scenelake.streaming import windows as sw

Q: dict[str, tuple] = {}
BATCHES = 3
LATE = "1 hour"  # lateness under which a replay in any order is complete
EPOCH = 1_700_000_000_000_000
FILE_ROWS = 500_000


def timed(df: DataFrame) -> DataFrame:
    """Footage time as event time."""
    return df.withColumn("timestamp", F.timestamp_micros(F.col("t_us") + F.lit(EPOCH)))


def replay(df: DataFrame, batches: int = BATCHES, **key) -> DataFrame:
    """``df`` as a stream of ``batches`` batches, dealt by a hash, then a row of another key far in the future, which ends every wait.

    A batch is one file, or several of some ``FILE_ROWS`` rows, so that no task writes or reads a whole batch of a large table.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/replay/{uuid.uuid4().hex}"
    df = settle(df)
    last = df.limit(1).withColumns({k: F.lit(x).cast(df.schema[k].dataType) for k, x in key.items()}).withColumn("timestamp", F.expr("timestamp'2040-01-01 00:00:00'"))
    files = batches * max(1, -(-df.count() // (batches * FILE_ROWS)))
    df.repartition(files, "timestamp", *[k for k in key]).write.mode("append").parquet(path)
    written = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-written // batches))).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream gives for what is there, through a file sink."""
    spark, base = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/drained/{uuid.uuid4().hex}"
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def motion(spark, d):
    out = drained(st.stream_motion_state(replay(timed(v.tracks(spark, d)), track_id=-1), lateness=LATE))
    return out.select("source_id", "track_id", "step", "motion", *(F.round(c, 6).alias(c) for c in ("speed", "dwell_s", "age_s", "distance")))


Q["stream_motion_state"] = (motion, f"SELECT source_id, track_id, step, motion, speed, dwell_s, age_s, distance FROM ({scene.Q['motion_state'][1]})")


def _zone_rows(spark, d):
    rows = replay(timed(v.tracks(spark, d)), track_id=-1)
    return drained(st.stream_zone_rows(rows, scene.ZONES, hold_s=0.3, lateness=LATE))


Q["stream_zone_rows"] = (
    lambda spark, d: _zone_rows(spark, d).select("source_id", "track_id", "step", "zone", F.coalesce("event", F.lit("-")).alias("event"), F.round("dwell_s", 6).alias("dwell_s")),
    scene.Q["zone_visits"][1],
)
Q["stream_crossings"] = (lambda spark, d: _zone_rows(spark, d).where("event is not null").select("source_id", "track_id", "step", "zone", "event"), scene.Q["crossings"][1])


def interaction(spark, d):
    """Pairs and poses come as two streams, in different orders."""
    state = scene._state(spark, d, poses=True)
    pairs = rel.pair_join(state.drop("keypoints"))
    poses = state.where("label = 'person'").select("source_id", "track_id", "step", "t_us", "keypoints")
    out = drained(st.stream_interaction(replay(timed(pairs), low=-1), replay(timed(poses), 2, track_id=-1).drop("t_us"), scene.TOUCH, lateness=LATE))
    return scene.edges(out)


Q["stream_interaction"] = (interaction, scene.Q["interaction"][1])


def relations(spark, d):
    pairs = scene._pairs(spark, d).select("source_id", "low", "high", "step", "t_us", "separation")
    out = drained(st.stream_relations(replay(timed(pairs), low=-1), lateness=LATE))
    return scene.edges(out.withColumnsRenamed({"low": "subject_track", "high": "object_track"}))


Q["stream_relations"] = (relations, f"SELECT * FROM ({scene.Q['near_relation'][1]}) UNION ALL SELECT * FROM ({scene.Q['closing_rate'][1]})")


def activities(spark, d):
    return scene.act(drained(st.stream_activities(replay(timed(scene._state(spark, d)), track_id=-1), scene.LOITER, lateness=LATE)))


Q["stream_activities"] = (activities, scene.Q["activities"][1])


def series(spark, d):
    """Entities per camera and six hours; a bucket is closed by rows of a later day."""
    out = drained(sw.stream_series(replay(v.observations(spark, d), camera_id="none"), interval="6 hours", lateness="40 days"))
    return out.where("camera_id <> 'none'").select("camera_id", F.unix_seconds("bucket_start").alias("start_s"), "value", "samples")


Q["stream_series"] = (
    series,
    v.sql("SELECT camera_id, us // 21600000000 * 21600 AS start_s, CAST(count(DISTINCT entity_id) AS DOUBLE) AS value, count(*) AS samples FROM obs GROUP BY 1, 2", "obs"),
)


def closed_visits(spark, d):
    inside = timed(zones.zone_join(v.tracks(spark, d), scene.ZONES).select("source_id", "track_id", "zone", "t_us"))
    out = drained(sw.stream_closed_visits(replay(inside, track_id=-1), hold="300 milliseconds", lateness=LATE))
    return out.where("track_id >= 0").select("source_id", "track_id", "zone", *((F.unix_micros(c) - EPOCH).alias(c) for c in ("entered", "last_inside")), "samples")


Q["stream_closed_visits"] = (
    closed_visits,
    v.sql(
        """SELECT source_id, track_id, zone, min(t_us) AS entered, max(t_us) AS last_inside, count(*) AS samples FROM (
        SELECT *, sum(CASE WHEN t_us - p <= 300000 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, track_id, zone ORDER BY t_us) AS visit FROM (
        SELECT *, lag(t_us) OVER (PARTITION BY source_id, track_id, zone ORDER BY t_us) AS p FROM zi WHERE inside)) GROUP BY source_id, track_id, zone, visit""",
        "isl", ctes={"zi": scene._IN},
    ),
)


def debounced(spark, d):
    """Alerts of a camera and rule at most every three hours, each firing decided as the watermark passes it."""
    a = v.alerts(spark, d)
    made = a.select(
        F.col("camera_id").alias("source_id"), "rule", F.lit("").alias("entity_id"), F.lit(0).cast("long").alias("island"), F.col("id").alias("step"), F.col("us").alias("t_us"),
        F.format_string("%020d", "id").alias("zone"), F.lit(10_800_000_000).cast("long").alias("cooldown_us"), "timestamp",
    )
    out = drained(st.stream_debounce(replay(made, source_id="none"), lateness="40 days"))
    return out.where("source_id <> 'none'").select(F.col("source_id").alias("camera_id"), "rule", F.col("step").alias("id"), F.col("fired").alias("kept"))


Q["stream_debounce"] = (debounced, scene.Q["debounce_alerts"][1])


def sunk(spark, d):
    """All alerts through the once-only sink, the stream started twice over one checkpoint."""
    base = f"{shared_folder(spark)}/sunk/{uuid.uuid4().hex}"
    rows = v.alerts(spark, d).select("id", "timestamp", "camera_id", "rule", "severity", "entity_id", "zone", "frame_index")
    settled = settle(rows)
    stream = spark.readStream.schema(settled.schema).option("maxFilesPerTrigger", 1).parquet(settled.inputFiles()[0].rpartition("/")[0])
    for _ in range(2):
        sw.stream_sink(stream, "events", f"{base}/store", f"{base}/checkpoint", every=None).awaitTermination()
    return store.read_events(spark, f"{base}/store").groupBy("camera_id", "rule").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


Q["stream_sink"] = (sunk, v.sql("SELECT camera_id, rule, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM alerts GROUP BY ALL", "alerts"))


def late(spark, d):
    """One row in seven comes two batches after the others: those behind the watermark of the batch between are dropped and counted."""
    rows = settle(timed(v.tracks(spark, d)))
    base = f"{shared_folder(spark)}/late/{uuid.uuid4().hex}"
    turn = F.when(F.col("k") % 7 == 3, 2).when(F.col("k") % 7 == 5, 1).otherwise(0)
    files = max(1, rows.count() // FILE_ROWS)
    for batch in range(3):
        dealt = rows.where(turn == batch)
        (dealt.coalesce(1) if files == 1 else dealt.repartition(files)).write.mode("append").parquet(f"{base}/in")
        if (written := len(spark.read.schema(rows.schema).parquet(f"{base}/in").inputFiles())) != files * (batch + 1):
            raise ValueError(f"{written} files after batch {batch} of {files} files each: a batch must be read whole")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    out = st.stream_motion_state(stream, lateness="2 seconds").writeStream.format("noop").queryName(f"late_{uuid.uuid4().hex}").option("checkpointLocation", f"{base}/checkpoint")
    query = out.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sw.late_rows(query).agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))


Q["stream_late_rows"] = (
    late, v.sql("SELECT count(*) AS dropped FROM tr WHERE k % 7 = 3 AND t_us <= (SELECT max(t_us) FROM tr WHERE k % 7 NOT IN (3, 5)) - 2000000", "tr"),
)
