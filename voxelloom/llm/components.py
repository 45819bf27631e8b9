"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm.common import release, stored


def _with_least(edges: DataFrame) -> DataFrame:
    """The different rows of edges (u, v), with the least v of each u as m and whether v is it."""
    order = Window.partitionBy("u").orderBy("v")
    rows = edges.select("u", "v", F.first("v").over(order).alias("m"), F.lag("v").over(order).alias("_before"))
    return rows.filter("_before is null or _before != v").select("u", "v", "m", F.col("_before").isNull().alias("first"))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for every node of edges (a, b).

    Nodes point to the least of their neighbourhood, once with their greater and once with their smaller neighbours in turn, until
    every component is a star. Edges never leave the executors; loops and repeated edges are harmless. No step makes more rows
    than there are edges, each is one shuffle, and what a round has shuffled and stored goes with the next one.
    """
    stars = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v"))
    before = None
    while (now := stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large).select(F.when(F.col("first"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        stars = stored(small)
        del both, large, small
        release(edges.sparkSession)
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
