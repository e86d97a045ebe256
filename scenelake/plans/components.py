"""Connected components of a table of links between whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.session import forget, settle


def component_of(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Each round points a node at its smallest neighbour, jumps to the end of such pointers and goes on with the links
    between these ends alone, so links and nodes shrink by a constant factor and a long path takes logarithmically many rounds.
    """
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    spark, rounds = edges.sparkSession, []
    while True:
        table = settle(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        while True:
            at = table.select("a", "to")
            onward = at.select(F.col("a").alias("to"), F.col("to").alias("far"))
            jumped = settle(at.join(onward, "to").select("a", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            forget(spark, table)
            table = jumped
            if jumped.where("moved").isEmpty():
                break
        at = table.select("a", "to")
        rounds.append(at)
        ends = edges.join(at.withColumnRenamed("to", "_a"), "a").join(at.select(F.col("a").alias("b"), F.col("to").alias("_b")), "b")
        rest = settle(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct())
        forget(spark, edges)
        edges = rest
        if edges.isEmpty():
            break
    out = rounds[-1]
    for at in rounds[-2::-1]:
        out = at.join(out.select(F.col("a").alias("to"), F.col("to").alias("far")), "to", "left").select("a", F.coalesce("far", "to").alias("to"))
    out = settle(out)
    forget(spark, edges, *rounds)
    return out.select(F.col("a").alias("node"), F.col("to").alias("component"))
