"""Connected components of a table of links, without a graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.llm.stages import store


def _state(links: DataFrame) -> tuple[int, int]:
    sums = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("s")).first()
    return sums["n"], sums["s"] or 0


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node that has links: node, component.

    ``links`` has columns a and b, in either order. Large-star and small-star steps in turn: each
    node's larger neighbours, then its smaller ones, are linked to the smallest; rounds grow with
    the logarithm of the number of nodes. Joins are on nodes, with one row per node on one side,
    so adaptive execution can split a hub's links.
    """
    links = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _state(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = store(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
