"""Event-time windows: series, closed visits, live judging, liveness, sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scenelake.functions.clock import slot_index
from scenelake.functions.robust import SENSITIVITY
from scenelake.operators.series import metric_named
from scenelake.plans.joins import join_on
from scenelake.session import remove_folder
from scenelake.sources.store import append_once, route_records

FRAME_LATENESS = "10 seconds"


def stream_series(
    rows: DataFrame, metric: str = "entities", *, interval: str = "1 hour", lateness: str = "1 hour", keys: Sequence[str] = ("camera_id",), start: str | None = None
) -> DataFrame:
    """A metric per closed bucket. Rows later than ``lateness`` are dropped and counted in the query's progress.

    Distinct entities are exact: one row per bucket and entity first, then a count of those.
    """
    m = metric_named(metric)
    marked = rows.withWatermark("timestamp", lateness)
    window = F.window("timestamp", interval, startTime=start)
    if metric != "entities":
        out = marked.groupBy(*keys, window).agg(m.value().cast("double").alias("value"), F.count(F.lit(1)).alias("samples"))
    else:
        each = marked.groupBy(*keys, "entity_id", window).agg(F.count(F.lit(1)).alias("_n"))
        again = F.window(F.window_time("window"), interval, startTime=start)
        out = each.groupBy(*keys, again.alias("window")).agg(F.count(F.lit(1)).cast("double").alias("value"), F.sum("_n").alias("samples"))
    return out.select(*keys, F.col("window.start").alias("bucket_start"), "value", "samples")


def stream_closed_visits(inside: DataFrame, *, hold: str = "1.5 seconds", lateness: str = FRAME_LATENESS) -> DataFrame:
    """Finished zone visits: a session per (source, track, zone) that ends when the hold passes without a row.

    A row exactly the hold after the last one still belongs to the visit.
    """
    s = F.session_window("timestamp", hold)
    visits = inside.withWatermark("timestamp", lateness).groupBy("source_id", "track_id", "zone", s).agg(
        F.min("timestamp").alias("entered"), F.max("timestamp").alias("last_inside"), F.count(F.lit(1)).alias("samples")
    )
    return visits.drop("session_window")


def stream_pairs(tracks: DataFrame, *, lateness: str = FRAME_LATENESS, max_entities: int = 24) -> DataFrame:
    """All pairs of the largest boxes of each frame, once the frame is complete."""
    from scenelake.functions.boxes import box_area, ground_distance

    one = F.struct((-box_area(F.col("box"))).alias("_a"), "track_id", "entity_id", "label", "box")
    frames = tracks.withWatermark("timestamp", lateness).groupBy("source_id", "step", "t_us", F.window("timestamp", "1 second")).agg(F.collect_list(one).alias("_all"))
    top = F.slice(F.array_sort("_all"), 1, max_entities)
    frames = frames.select("source_id", "step", "t_us", F.window_time("window").alias("timestamp"), F.array_sort(F.transform(top, lambda e: F.struct(e["track_id"], e["entity_id"], e["label"], e["box"]))).alias("_all"))
    firsts = frames.select("source_id", "step", "t_us", "timestamp", "_all", F.posexplode("_all").alias("_i", "first"))
    later = F.slice("_all", F.col("_i") + 2, F.greatest(F.size("_all") - F.col("_i") - 1, F.lit(0)))
    pairs = firsts.select("source_id", "step", "t_us", "timestamp", "first", F.explode(later).alias("second"))
    return pairs.select(
        "source_id", "step", "t_us", "timestamp", F.col("first.track_id").alias("low"), F.col("second.track_id").alias("high"),
        ground_distance(F.col("first.box"), F.col("second.box")).alias("separation"),
    )


def stream_judge(series: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("camera_id",), *, period_hours: int = 168, sensitivity: float = SENSITIVITY) -> DataFrame:
    """Closed buckets against a stored baseline: a stream-static join on the slot."""
    known = baseline.select(*keys, "slot", F.col("centre").alias("expected"), "spread", "trustworthy")
    joined = join_on(series.withColumn("slot", slot_index(F.col("bucket_start"), period_hours)), known, [*keys, "slot"], "left")
    usable = F.coalesce("trustworthy", F.lit(False))
    score = F.when(usable & (F.col("spread") > 0), F.abs(F.col("value") - F.col("expected")) / F.col("spread"))
    verdict = F.when(~usable, "unjudged").when(score >= sensitivity, "anomaly").otherwise("normal")
    return joined.withColumns({"score": score, "verdict": verdict}).drop("trustworthy")


def stream_liveness(beats: DataFrame, silence_ms: int = 180_000) -> DataFrame:
    """``alive`` when a camera's first beat arrives, ``dark`` when it has been silent for ``silence_ms``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"camera_id": [key[0]], "status": ["dark"], "last_beat_us": [last]})
            return
        latest = max(int(f["beat_us"].max()) for f in frames)
        fresh = not state.exists
        if state.exists:
            latest = max(latest, state.get[0])
        state.update((latest,))
        state.setTimeoutDuration(silence_ms)
        if fresh:
            yield pd.DataFrame({"camera_id": [key[0]], "status": ["alive"], "last_beat_us": [latest]})

    rows = beats.select("camera_id", F.unix_micros("timestamp").alias("beat_us"))
    return rows.groupBy("camera_id").applyInPandasWithState(
        run, "camera_id string, status string, last_beat_us long", "last_beat_us long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def _forget_staged(batch: DataFrame, checkpoint: str, batch_id: int) -> None:
    """A batch starts once the one before is committed and can no longer be replayed; so the folder before that goes."""
    remove_folder(batch.sparkSession, f"{checkpoint}/staged/{batch_id - 1}")


def stream_sink(stream: DataFrame, kind: str, path: str, checkpoint: str, *, every: str | None = "2 seconds") -> StreamingQuery:
    """Append to a stored table. With ``every`` None all that is there is taken and the query ends.

    Each batch goes through a staging folder under its id, so a replay after a crash at any point writes no row twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_once(batch, kind, path, f"{checkpoint}/staged/{batch_id}")
        _forget_staged(batch, checkpoint, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_route(stream: DataFrame, path: str, checkpoint: str, *, every: str | None = "2 seconds") -> StreamingQuery:
    """``route_records`` of a mixed stream: one query feeds all three tables, each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        route_records(batch, path, f"{checkpoint}/staged/{batch_id}")
        _forget_staged(batch, checkpoint, batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


LATE_ROWS = "query string, run_id string, batch long, operator int, kind string, dropped long"


def _dropped(progress: dict) -> list[tuple]:
    """A row per stateful operator that dropped rows for being behind the watermark."""
    return [
        (progress["name"], str(progress["runId"]), int(progress["batchId"]), at, op["operatorName"], int(op["numRowsDroppedByWatermark"]))
        for at, op in enumerate(progress["stateOperators"]) if op["numRowsDroppedByWatermark"]
    ]


def late_rows(query: StreamingQuery) -> DataFrame:
    """What the watermark dropped, per batch and operator, in the progress a query still remembers.

    A row is late when it is not past the watermark of the batch before, up to which everything has been processed. Keyed
    operators (``in_order``) count rows; a windowed aggregate counts the groups of a batch that came too late.
    """
    found = [r for p in query.recentProgress for r in _dropped(json.loads(p.json) if hasattr(p, "json") else p)]
    return SparkSession.active().createDataFrame(found, LATE_ROWS)


class LateRowLog(StreamingQueryListener):
    """Appends the late rows of every query of a session to a table at ``path``, as batches end: ``spark.streams.addListener(LateRowLog(spark, path))``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        found = _dropped(json.loads(event.progress.json))
        if found:
            self.spark.createDataFrame(found, LATE_ROWS).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(LATE_ROWS).parquet(self.path)
