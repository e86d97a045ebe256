"""Detections: thresholds, clipping, overlap suppression, trajectories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenelake.functions.boxes import box_area, box_center_x, box_center_y, box_height, box_width, clipped, iou
from scenelake.operators.presence import ISLAND
from scenelake.plans.segments import SLICE, SLICE_US, drop_halo, local, with_halo
from scenelake.plans.suppression import suppress_in_rounds

FRAME = ("source_id", "frame_index")
MAX_DETECTIONS = 100


def above_confidence(dets: DataFrame, threshold: float) -> DataFrame:
    return dets.where(F.col("confidence") >= threshold)


def keep_classes(dets: DataFrame, classes: Sequence[str], known: Sequence[str]) -> DataFrame:
    """Rows of the named classes; apply after suppression. A name the detector does not know is an error."""
    wrong = sorted({c.lower() for c in classes} - {k.lower() for k in known})
    if wrong:
        raise ValueError(f"unknown classes {wrong}")
    return dets.where(F.lower("label").isin([c.lower() for c in classes]))


def clip_boxes(dets: DataFrame, frame_width: float = 640.0, frame_height: float = 480.0) -> DataFrame:
    """Boxes cut to the frame; those left without area are dropped."""
    out = dets.withColumn("box", clipped(F.col("box"), F.lit(frame_width), F.lit(frame_height)))
    return out.where((box_width(F.col("box")) > 0) & (box_height(F.col("box")) > 0))


def observed(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("time_since_update") == 0)


def coasting(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("time_since_update") > 0)


def confirmed(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("state") == "confirmed")


def top_per_frame(dets: DataFrame, k: int, frame: Sequence[str] = FRAME) -> DataFrame:
    """The k most confident boxes of each frame, lower id first among equals; ranked before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("confidence"), "det_id"))
    return dets.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def prompt_union(by_prompt: Mapping[str, DataFrame], k: int = 50) -> DataFrame:
    """Detections of several prompts together, the k most confident per frame."""
    parts = [df.withColumn("prompt", F.lit(prompt)) for prompt, df in by_prompt.items()]
    if not parts:
        raise ValueError("no prompts given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top_per_frame(out, k)


def largest_region(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """The biggest box of each group, whatever its score."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(box_area(F.col("box")), -F.col("det_id")))
    return df.groupBy(*by).agg(best.alias("_r")).select(*by, "_r.*")


def pose_subjects(tracks: DataFrame, k: int = 6) -> DataFrame:
    """The k largest confirmed and observed people of each frame."""
    from scenelake.operators.relations import largest_per_frame

    people = tracks.where((F.lower("label") == "person") & (F.col("state") == "confirmed") & (F.col("time_since_update") == 0))
    return largest_per_frame(people, k, FRAME)


def trajectories(tracks: DataFrame, n: int = 30, *, width: int = SLICE_US) -> DataFrame:
    """The last ``n`` centres of each track, oldest first, with path length and net displacement.

    Needs presence islands. A halo of ``n`` longest steps would be wasteful, so slices overlap by time:
    ``n`` steps of at most 2 s each.
    """
    reach = n * 2_000_000
    point = F.struct(box_center_x(F.col("box")).alias("x"), box_center_y(F.col("box")).alias("y"))
    h = with_halo(tracks.withColumn("_p", point), "t_us", max(width, reach), reach)
    w = local(ISLAND, "t_us").rowsBetween(-(n - 1), 0)
    out = drop_halo(h.withColumn("history", F.collect_list("_p").over(w)))
    legs = F.transform(
        F.sequence(F.lit(2), F.size("history")),
        lambda i: F.hypot(F.element_at("history", i)["x"] - F.element_at("history", i - 1)["x"], F.element_at("history", i)["y"] - F.element_at("history", i - 1)["y"]),
    )
    first, last = F.element_at("history", 1), F.element_at("history", -1)
    path = F.when(F.size("history") > 1, F.aggregate(legs, F.lit(0.0), lambda s, d: s + d)).otherwise(0.0)
    return out.withColumns(
        {"path_length": path, "displacement": F.hypot(last["x"] - first["x"], last["y"] - first["y"])}
    ).drop("_p", SLICE)


def _copies_collapsed(dets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of boxes alike to the last digit only the best can be kept; found with a partial aggregate."""
    rest = [c for c in dets.columns if c not in (*group, "box")]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col("det_id")))
    # Boxes without area overlap nothing, copies included, so they stay apart.
    apart = F.when(box_area(F.col("box")) > 0, F.lit(0).cast("long")).otherwise(F.col("det_id"))
    alike = dets.groupBy(*group, "box", apart.alias("_apart")).agg(best.alias("_r"))
    return alike.select(*group, "box", "_r.*").select(dets.columns)


def nms(
    dets: DataFrame,
    iou_threshold: float = 0.45,
    max_detections: int = MAX_DETECTIONS,
    *,
    class_aware: bool = True,
    walk_limit: int = 5_000,
) -> DataFrame:
    """Keep the best-scored box and drop those of its class overlapping it by more than the threshold,
    again and again; then the ``max_detections`` best per frame.

    A frame's class is walked as one short array. Groups above ``walk_limit`` boxes are settled in
    rounds of joins on grid cells instead, with the same result.
    """
    if not 0.0 <= iou_threshold <= 1.0:
        raise ValueError("iou_threshold must be in [0, 1]")
    group = [*FRAME, *(["label"] if class_aware else [])]
    sizes = dets.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > walk_limit).select(*group)
    if large.isEmpty():
        return top_per_frame(_walked(dets, group, iou_threshold), max_detections)
    small = _walked(dets.join(large, group, "left_anti"), group, iou_threshold)
    crowded = dets.join(large, group, "left_semi")
    if iou_threshold < 1.0:
        crowded = _copies_collapsed(crowded, group)
    crowded = suppress_in_rounds(crowded, group, iou_threshold)
    return top_per_frame(small.unionByName(crowded.select(small.columns)), max_detections)


def _walked(rows: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*group, "confidence", "det_id", "box")]
    one = F.struct((-F.col("confidence")).alias("_s"), "det_id", "box", F.struct(*rest, "confidence").alias("_x") if rest else F.struct("confidence").alias("_x"))
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(one)).alias("_all"))

    def step(kept: Column, d: Column) -> Column:
        hidden = F.exists(kept, lambda k: iou(k["box"], d["box"]) > threshold)
        return F.when(hidden, kept).otherwise(F.concat(kept, F.array(d)))

    kind = packed.schema["_all"].dataType
    kept = F.aggregate("_all", F.array().cast(kind), step)
    out = packed.select(*group, F.explode(kept).alias("_k"))
    return out.select(*group, "_k.det_id", "_k.box", "_k._x.*").select(rows.columns)
