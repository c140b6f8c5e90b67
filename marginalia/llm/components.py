"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps replace each node's edges by edges to the least node it knows, so that every
component ends as one star around its least node. A step is an aggregate with partial sums
and a join on the node; a hub's rows are never gathered, so a component that holds a third
of all nodes is only a skewed join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from marginalia.llm.shared import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with a sum over them that changes when they do, taken on the way."""
    seen = Observation()
    found = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("sum")))
    return found, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs, u <> v, to (node, component): each node that has an edge and the least node it reaches."""
    edges, before = _marked(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while before[0]:
        edges, now = _marked(_small(_large(edges)))
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
