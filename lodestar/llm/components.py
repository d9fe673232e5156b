"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is a partial aggregate (the smallest neighbour) and one join on the
node, so a node with very many edges is pre-aggregated and its join partition can be
split.  Each step is written to the shared scratch folder; nothing reaches the driver
but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked with the smallest of them."""
    least = _least(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges(u, v)``; null ends are left out.

    An empty edge list gives no rows.  Repeated edges, loops and either direction are allowed.
    """
    directed = (edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = staged(directed, "cc")
    mark = None
    while True:
        # A star is its centre's edges: large-star may turn nothing while small-star still does.
        now = staged(_small_star(_large_star(now)), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
