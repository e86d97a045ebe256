"""Zones: who is inside which polygon, visits, and boundary crossings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.boxes import box_bottom_center, grid_cells, point_in_fixed_polygon, point_in_polygon
from scenelake.functions.clock import us
from scenelake.operators.presence import ISLAND
from scenelake.plans.bounds import broadcast_if_small
from scenelake.plans.segments import SLICE, SLICE_US, carry, crossing, drop_halo, local, with_halo
from scenelake.session import settle

GRID = 16
INLINE_ZONES = 64
HOLD_S = 1.5


@dataclass(frozen=True)
class Zone:
    """A named polygon in coordinates normalised to the frame."""

    name: str
    points: tuple[tuple[float, float], ...]
    kind: str = "area"

    def __post_init__(self) -> None:
        if not self.name or len(self.points) < 3:
            raise ValueError("a zone needs a name and at least three points")
        if any(not 0.0 <= v <= 1.0 for p in self.points for v in p):
            raise ValueError(f"zone {self.name!r}: coordinates must be within [0, 1]")


def zone_table(spark, zones: Sequence[Zone]) -> DataFrame:
    """Zones as a table, one row per grid cell their bounding box touches."""
    rows = [
        (i, z.name, z.kind, [{"x": x, "y": y} for x, y in z.points], cell)
        for i, z in enumerate(zones)
        for cell in grid_cells(z.points, GRID)
    ]
    return spark.createDataFrame(
        rows, "zone_order int, zone string, zone_kind string, points array<struct<x:double,y:double>>, cell int"
    )


def _ground(width: Column, height: Column) -> tuple[Column, Column]:
    point = box_bottom_center(F.col("box"))
    ok = (width > 0) & (height > 0)
    return F.when(ok, point["x"] / width), F.when(ok, point["y"] / height)


def zone_hits(zones: Sequence[Zone], frame_width: float = 640.0, frame_height: float = 480.0) -> Column:
    """The zones (zone_order, zone, zone_kind) that hold the ground point of a row, as an array in list order."""
    if not zones:
        raise ValueError("no zones given")
    x, y = _ground(F.lit(frame_width), F.lit(frame_height))
    hits = [
        F.when(
            F.coalesce(point_in_fixed_polygon(x, y, z.points), F.lit(False)),
            F.struct(F.lit(i).alias("zone_order"), F.lit(z.name).alias("zone"), F.lit(z.kind).alias("zone_kind")),
        )
        for i, z in enumerate(zones)
    ]
    return F.array_compact(F.array(*hits))


def zone_join(tracks: DataFrame, zones: Sequence[Zone] | DataFrame, frame_width: float = 640.0, frame_height: float = 480.0) -> DataFrame:
    """Every (track row, zone) with the ground point inside; overlapping zones are all kept.

    A short list of zones becomes one expression per zone in the scan stage. A longer list, or a
    table (optionally per ``source_id``), is an equi-join on a 16 x 16 grid cell.
    """
    if not isinstance(zones, DataFrame) and len(zones) <= INLINE_ZONES:
        return tracks.select("*", F.inline(zone_hits(zones, frame_width, frame_height)))
    x, y = _ground(F.lit(frame_width), F.lit(frame_height))
    table = broadcast_if_small(zones if isinstance(zones, DataFrame) else zone_table(tracks.sparkSession, zones))
    cell = (F.least(F.floor(y * GRID), F.lit(GRID - 1)) * GRID + F.least(F.floor(x * GRID), F.lit(GRID - 1))).cast("int")
    on = ["cell", *[c for c in ("source_id",) if c in table.columns]]
    near = tracks.withColumn("cell", cell).join(table, on)
    return near.where(point_in_polygon(x, y, F.col("points"))).drop("cell", "points")


def zone_visits(
    tracks: DataFrame,
    zones: Sequence[Zone] | DataFrame,
    *,
    hold_s: float = HOLD_S,
    frame_width: float = 640.0,
    frame_height: float = 480.0,
    width: int = SLICE_US,
) -> DataFrame:
    """Occupancy rows with dwell and crossing event, from tracks with presence islands.

    An absence up to ``hold_s`` does not end a visit. ``entered`` is reported while the dwell is
    at most ``hold_s``; ``exited`` on the steps up to ``hold_s`` after the last one inside, with
    the dwell frozen. A visit ends when an outside step is seen past the hold, so it survives a
    longer gap with no step in it.
    """
    hold = us(hold_s)
    reach = hold + us(4.5)
    keys = [*ISLAND, "zone"]
    keep = [*ISLAND, "step", "t_us", "entity_id", "label"]
    base = tracks.select(*keep, "box", "prev_t", "next_t")
    inside = with_halo(zone_join(base, zones, frame_width, frame_height).drop("box"), "t_us", width, reach, reach)
    among = crossing(tracks, ISLAND, "t_us", "island_t", width)
    w = local(keys, "t_us")
    inside = inside.withColumns({"_p": F.lag("t_us").over(w), "_n": F.lead("t_us").over(w)})
    absent_too_long = (F.col("prev_t") > F.col("_p")) & (F.col("prev_t") - F.col("_p") > hold)
    starts = F.col("_p").isNull() | F.coalesce(absent_too_long, F.lit(False))
    visits = carry(drop_halo(inside), keys, ["t_us"], lasts={"entered_t": F.when(starts, F.col("t_us"))}, width=width, among=among)
    visits = settle(visits.drop(SLICE).withColumn("dwell_us", F.col("t_us") - F.col("entered_t")))

    leaves = F.col("next_t").isNotNull() & (F.col("_n").isNull() | (F.col("_n") > F.col("next_t")))
    beat = F.floor(F.col("t_us") / F.lit(max(hold, 1))).cast("long")
    exits = visits.where(leaves).select(
        *keys, "zone_order", "zone_kind", "entered_t", "dwell_us", F.col("t_us").alias("_last"), "_n",
        F.explode(F.array(beat, beat + 1)).alias("_beat"),
    )
    rest = tracks.select(*keep).withColumn("_beat", beat)
    tails = rest.join(exits, [*ISLAND, "_beat"]).where(
        (F.col("t_us") > F.col("_last"))
        & (F.col("t_us") - F.col("_last") <= hold)
        & (F.col("_n").isNull() | (F.col("t_us") < F.col("_n")))
    )
    shape = [*keep, "zone", "zone_kind", "zone_order", F.col("dwell_us"), "event"]
    here = visits.withColumn("event", F.when(F.col("dwell_us") <= hold, "entered")).select(*shape)
    gone = tails.withColumn("event", F.lit("exited")).select(*shape)
    return here.unionByName(gone).withColumn("dwell_s", F.col("dwell_us") / 1e6).drop("dwell_us")


def crossings(visits: DataFrame) -> DataFrame:
    """Rows on which a boundary was (or was just) crossed."""
    return visits.where(F.col("event").isNotNull())


def occupied(visits: DataFrame) -> DataFrame:
    """Rows of entities that are inside now."""
    return visits.where(~F.col("event").eqNullSafe(F.lit("exited")))


def zone_occupancy(visits: DataFrame) -> DataFrame:
    """Entities per zone and frame."""
    return occupied(visits).groupBy("source_id", "step", "t_us", "zone").agg(F.count(F.lit(1)).alias("entities"))
