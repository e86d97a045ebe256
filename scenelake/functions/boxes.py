"""Box and point expressions. A box is a struct column with doubles x1, y1, x2, y2."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def box_width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def box_height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def box_center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def box_center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def box_bottom_center(b: Column) -> Column:
    """The point where the entity meets the ground."""
    return F.struct(box_center_x(b).alias("x"), b["y2"].alias("y"))


def box_xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), box_width(b).alias("w"), box_height(b).alias("h"))


def clipped(b: Column, width: Column, height: Column) -> Column:
    """The part of the box inside a ``width`` x ``height`` frame."""

    def clamp(v: Column, top: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))

    return box(clamp(b["x1"], width), clamp(b["y1"], height), clamp(b["x2"], width), clamp(b["y2"], height))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that do not meet or have no area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = box_area(a) + box_area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(0.0)


def ground_distance(a: Column, b: Column) -> Column:
    """Distance of the two ground points in mean entity heights."""
    scale = F.greatest((box_height(a) + box_height(b)) / 2, F.lit(1.0))
    return F.hypot(box_center_x(a) - box_center_x(b), a["y2"] - b["y2"]) / scale


def speed_heights(vx: Column, vy: Column, height: Column) -> Column:
    """Speed in entity heights per second."""
    return F.hypot(vx, vy) / F.greatest(height, F.lit(1.0))


def bearing_deg(vx: Column, vy: Column, moving: Column | None = None) -> Column:
    """Clockwise degrees from straight up, image y growing downwards; null when standing."""
    angle = F.pmod(F.degrees(F.atan2(vx, -vy)), F.lit(360.0))
    going = (vx != 0) | (vy != 0)
    return F.when(going if moving is None else going & moving, angle)


def point_in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test of a point against an array of struct(x, y).

    Each edge is met from its first vertex on, here and for a fixed polygon, so that a point on an edge falls on one side in both.
    """
    n = F.size(points)

    def crosses(inside: Column, i: Column) -> Column:
        p = F.element_at(points, i + 1)
        q = F.element_at(points, F.pmod(i - 1, n) + 1)
        straddles = (p["y"] > y) != (q["y"] > y)
        at = q["x"] + (y - q["y"]) / F.when(p["y"] != q["y"], p["y"] - q["y"]) * (p["x"] - q["x"])
        return inside != (straddles & F.coalesce(x < at, F.lit(False)))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


def point_in_fixed_polygon(x: Column, y: Column, points: Sequence[tuple[float, float]]) -> Column:
    """The same test for a polygon known when the query is written: stays in generated code."""
    inside = F.lit(False)
    for (px, py), (qx, qy) in zip(points, [points[-1], *points[:-1]]):
        if py == qy:
            continue
        straddles = (F.lit(py) > y) != (F.lit(qy) > y)
        inside = inside != (straddles & (x < F.lit(qx) + (y - qy) / (py - qy) * (px - qx)))
    return inside


def polygon_centroid(points: Column) -> Column:
    """Mean of the vertices."""
    n = F.size(points)
    return F.struct(
        (F.aggregate(points, F.lit(0.0), lambda s, p: s + p["x"]) / n).alias("x"),
        (F.aggregate(points, F.lit(0.0), lambda s, p: s + p["y"]) / n).alias("y"),
    )


def tilt_from_vertical(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan2(F.abs(dx), F.abs(dy)))


def margin(value: Column, boundary: float | Column, span: float) -> Column:
    """How far past a decision boundary a value sits, as 0 to 1."""
    return F.least(F.greatest(F.abs(value - boundary) / span, F.lit(0.0)), F.lit(1.0))


def polygon_box(points: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


def grid_cells(points: Sequence[tuple[float, float]], n: int) -> list[int]:
    """Cells of an ``n`` x ``n`` grid over the unit square that a polygon's box touches."""
    x1, y1, x2, y2 = polygon_box(points)

    def span(lo: float, hi: float) -> range:
        return range(max(0, math.floor(lo * n)), min(n - 1, math.floor(hi * n)) + 1)

    return [cy * n + cx for cy in span(y1, y2) for cx in span(x1, x2)]
