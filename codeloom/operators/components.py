"""Connected components and stars over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import checkpoint_counting


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b): the least node reachable, by alternating large-star and small-star.

    Each star links a node's neighbours to its least one; neighbours are aggregated, never gathered,
    so a node with very many links stays spread. Links of a node to itself and nulls are left out.
    """
    plain = edges.select("a", "b").dropna().filter("a <> b")
    links, size = checkpoint_counting(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        after, now = checkpoint_counting(small)
        if now == size and after.join(links, ["a", "b"], "left_anti").isEmpty():
            break
        links, size = after, now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
