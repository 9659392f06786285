"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.plans.skew import durable


def _is_star(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller end only, which is no larger end itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component is the smallest node reachable.

    Each step aggregates the smallest neighbour of a node with map-side combine and joins it back on the node, so a node with
    very many edges is never one task's list. Edges shrink to a star per component in a logarithmic number of steps; the loop
    ends when all are stars. Null ends and self loops are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = durable(e, "edges")
    while not _is_star(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = small.select("u", F.col("m").alias("v")).unionByName(
            small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        ).where("u > v").distinct()
        e = durable(e, "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links (a, b): only the links between components go through the steps again."""
    ends = links
    for side in ("a", "b"):
        known = comp.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        ends = ends.join(known, side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    over = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("into"))
    fresh = over.select(F.col("component").alias("node")).join(comp, "node", "left_anti").select("node", F.col("node").alias("component"))
    return comp.unionByName(fresh).join(over, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
