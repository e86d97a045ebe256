"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.session import settle


def apart(grouped: DataFrame, key: str) -> DataFrame:
    """An aggregate dealt anew by a hash of its key.

    A join on the key then shuffles both sides for the join alone, and only such a shuffle is one that
    adaptive execution may split where a key is hot.
    """
    return grouped.repartition(F.xxhash64(key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; the component is its smallest node.

    Each round joins the edges with one minimum per node, so a star of any size is aggregated map-side
    and its rows can be split over tasks. Rounds end when the edges no longer change: every node then
    points at its smallest; their number is logarithmic in practice.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = print_of(now)
    while last[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        up = both.join(large, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = apart(up.groupBy("u").agg(F.min("v").alias("m")), "u")
        down = up.join(small, "u")
        now = settle(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        after = print_of(now)
        if after == last:
            break
        last = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
