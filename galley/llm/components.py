"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> Saved:
    """``u, v`` (any ordered type, no nulls) -> ``u, v``: every node that is not least in its component, with the least.

    Neighbour lists are never gathered: a round is two joins with per-node minima, which Spark splits when a node is
    hot. Every round is written to the shared folder; the driver only sees a count and a checksum. The number of
    rounds grows with the logarithm of the longest chain.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now, mark = saved(ends, "edges"), None
    while True:
        following = saved(_small_star(_large_star(now.df)), "edges")
        seen = following.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now.drop()
        now = following
        if tuple(seen) == mark:
            return now
        mark = tuple(seen)
