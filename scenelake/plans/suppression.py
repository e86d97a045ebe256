"""Overlap suppression for crowded groups: rounds of grid joins instead of one long walk."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.boxes import box_center_x, box_center_y, box_height, box_width, iou
from scenelake.session import settle


def suppress_in_rounds(rows: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    """The boxes a greedy walk by score would keep.

    Boxes overlapping by more than ``threshold`` have longer sides within a factor of each other and
    centres no farther apart than the larger of them, so each lies in one of few grid cells around the
    other. A round keeps every open box that outranks all open boxes of the cells around it, then drops
    what the kept ones hide. The kept boxes of a cell cannot overlap much, so a cell needs few rounds.
    """
    spread = math.ceil(math.log2(1.0 / max(threshold, 1e-3)))
    side = F.greatest(box_width(F.col("box")), box_height(F.col("box")), F.lit(1e-6))
    level = F.floor(F.log2(side)).cast("int")
    open_ = settle(rows.withColumns({"_level": level, "_rank": F.struct("confidence", -F.col("det_id"))}))
    kept = rows.limit(0)
    cell = [*group, "_l", "_cx", "_cy"]
    while not open_.isEmpty():
        best = _home(open_, spread).groupBy(*cell).agg(F.max("_rank").alias("_best"))
        top = (
            _around(open_, spread)
            .join(best, cell)
            .groupBy(*group, "det_id")
            .agg(F.max("_best").alias("_best"), F.max("_rank").alias("_own"))
            .where(F.col("_own") >= F.col("_best"))
        )
        chosen = settle(open_.join(top.select(*group, "det_id"), [*group, "det_id"], "left_semi"))
        kept = kept.unionByName(chosen.select(rows.columns))
        reach = _around(chosen, spread).select(*cell, F.col("box").alias("_kbox"), F.col("det_id").alias("_kid"))
        gone = (
            _home(open_, spread)
            .join(reach, cell)
            .where((F.col("_kid") == F.col("det_id")) | (iou(F.col("box"), F.col("_kbox")) > threshold))
            .select(*group, "det_id")
        )
        open_ = settle(open_.join(gone, [*group, "det_id"], "left_anti"))
    return kept


def _size(level: Column, spread: int) -> Column:
    """Cell side at a level: no partner's centre is farther away than this."""
    return F.pow(F.lit(2.0), level + spread + 1)


def _home(rows: DataFrame, spread: int) -> DataFrame:
    """The one cell a box lies in."""
    size = _size(F.col("_level"), spread)
    cx, cy = box_center_x(F.col("box")), box_center_y(F.col("box"))
    return rows.withColumns({"_l": F.col("_level"), "_cx": F.floor(cx / size).cast("long"), "_cy": F.floor(cy / size).cast("long")})


def _around(rows: DataFrame, spread: int) -> DataFrame:
    """The cells a partner may lie in: three by three at each level in reach."""
    levels = rows.withColumn("_l", F.explode(F.sequence(F.col("_level") - spread, F.col("_level") + spread)))
    size = _size(F.col("_l"), spread)

    def span(centre: Column) -> Column:
        at = F.floor(centre / size).cast("long")
        return F.sequence(at - 1, at + 1)

    cx, cy = box_center_x(F.col("box")), box_center_y(F.col("box"))
    return levels.withColumn("_cx", F.explode(span(cx))).withColumn("_cy", F.explode(span(cy)))
