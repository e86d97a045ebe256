"""Points on the edges of a polygon."""

from pyspark.sql import functions as F

from catalog import scene
from scenelake.functions.boxes import point_in_fixed_polygon, point_in_polygon


def inside(x, y, points):
    """Edges met from their first vertex on, as the SQL of the catalogue has them."""
    crossed = 0
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        crossed += ay != by and (by > y) != (ay > y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return crossed % 2 == 1


def test_points_on_an_edge_fall_on_the_side_that_the_sql_gives(spark):
    kite = scene.ZONES[2].points
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in kite])
    at = spark.range(640 * 2 * 160).select(((F.col("id") % 1280) / 2 / 640).alias("x"), (((F.col("id") / 1280).cast("int") * 2 + 100) / 480.0).alias("y"))
    got = at.select("x", "y", point_in_polygon(F.col("x"), F.col("y"), points).alias("a"), point_in_fixed_polygon(F.col("x"), F.col("y"), kite).alias("b")).collect()
    assert [r for r in got if not r["a"] == r["b"] == inside(r["x"], r["y"], kite)] == []
