"""Connected components of a graph of pairs, by alternating large and small stars, in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node links its larger (large) or its not larger neighbours, and itself, to the smallest of all of them.

    The smallest neighbour is reduced before the shuffle and joined back, so no node's neighbours are ever gathered."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    near = both.join(low, "a")
    out = near.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the pairs (a, b) of longs; a pair's order doesn't matter."""
    now = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = written(star(star(now, True), False), "edges")
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (found.n, found.s) == mark:
            break
        mark = (found.n, found.s)
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
