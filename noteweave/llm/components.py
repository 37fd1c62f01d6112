"""Connected components of an edge table, by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.llm.storage import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the smallest node reachable.

    Each round links nodes to the smallest neighbour seen from above (large star) and from below
    (small star) until nothing changes; the number of rounds grows with the logarithm of the paths' length.
    Only counts and a checksum reach the driver.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _state(now)
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        now = stored(small.union(lowest.select("a", F.col("least").alias("b"))).distinct())
        before, seen = seen, _state(now)
        if before == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()
