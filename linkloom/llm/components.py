"""Connected components by alternating large-star and small-star, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.shared import checkpointed


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the least node around it."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def state(edges: DataFrame) -> tuple:
    """A number of rows and a sum of their hashes: equal states are equal sets of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(u, v)``; a component is named by its least node.

    Rounds go on until the links stay the same; each is checkpointed, so a lost executor never
    brings back earlier rounds. Nothing of the links reaches the driver but a count and a sum.
    Links of a node to itself and repeated links are allowed; without links there are no rows.
    """
    edges = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    before = None
    while (now := state(edges)) != before:
        before = now
        edges = checkpointed(small_star(large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
