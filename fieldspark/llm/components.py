"""Distributed union-find: connected components by alternating large-star and small-star contraction.

Each pass points every node's larger (then smaller) neighbours at the least node around it. Minima are grouped with
partial aggregation and joined back, so a hub with any number of neighbours is split by adaptive skew joins and never
gathered. Each pass is written to the shared folder, which cuts the lineage; the loop ends when all edges
are stars around roots, after a number of passes logarithmic in the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _towards(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def _pass(e: DataFrame) -> DataFrame:
    """One large-star, then one small-star, on edges (u, v) with v < u."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = _towards(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    # large holds v < u; now each node's smaller neighbours, and the node, go to the least of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = _towards(large, least)
    small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(moved.select("u", F.col("m").alias("v")))
    return small.distinct()


def _is_stars(e: DataFrame) -> bool:
    """Whether every edge leads to a root: no target is a source too, and each source has one target. One job tells."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    seen = ends.groupBy("x").agg(F.sum("s").alias("s"), F.max("t").alias("t"))
    return not seen.agg(F.max(((F.col("s") > 1) | (F.col("s") == 1) & (F.col("t") == 1)).cast("int"))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in ``links``; the root is its component's least node. Loops, nulls and repeats in ``links`` count for nothing."""
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = stored(e, "links")
    while not _is_stars(e):
        e = stored(_pass(e), "links")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
