"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut


def _least(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """node, neighbour and the least node of the node's neighbourhood (itself included)."""
    both = edges.select("u", "v") if smaller_only else edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def _oriented(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge; the component is its least node.

    Each round is two aggregations and joins over the edges; rounds grow with the logarithm of the longest path. No
    neighbourhood is ever collected: a hub is one aggregate and a join that Spark can split.
    """
    now = cut(edges.select(*_oriented(F.col(a), F.col(b))).filter("u != v").distinct())
    seen = None
    while True:
        large = _least(now, False).filter("v > u").select(*_oriented(F.col("v"), F.col("m"))).filter("u != v").distinct()
        s = _least(large, True)
        small = s.select(*_oriented(F.col("v"), F.col("m"))).unionByName(s.select(*_oriented(F.col("u"), F.col("m")))).filter("u != v").distinct()
        now = cut(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
