"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it has more than 1/HOT_SHARE of the rows, so that at most
# HOT_SHARE keys can be hot: the hot list is small at any data size.
HOT_SHARE = 200
# Keys that a sketch of frequent keys keeps: the error of a count is a few rows in so many.
TRACKED = 20_000
# Pieces of a hot key for every task's fair share of rows that it has, and most pieces of one key.
PIECES, MOST_PIECES = 16, 65_536


def hot_keys(table: DataFrame, key: str, share: int = HOT_SHARE) -> list[tuple[str, float]]:
    """Keys with more than ``1/share`` of the non-null-keyed rows (at most ``share``), and the share of each.

    One pass with a sketch of frequent keys, bounded in memory and merged over the tasks.  The list is taken once, so both sides of a join
    know the same keys; counts are estimates, on which only the number of pieces depends.
    """
    keyed = table.where(F.col(key).isNotNull())
    row = keyed.agg(F.expr(f"approx_top_k(`{key}`, {int(share)}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    return [(r["item"], r["count"] / row["n"]) for r in row["top"] or [] if r["count"] * share > row["n"]]


def left_lookup(rows: DataFrame, lookup: DataFrame, key: str, row_id: str, share: int = HOT_SHARE) -> DataFrame:
    """Left join to a table that is unique by ``key``, with hot keys salted.

    Rows of a hot key spread by their own id (the same salt when a task is run again) over pieces in proportion to the
    key's share, each a fraction of what a task holds anyway, and its single lookup row is repeated per piece.  Rows without a key match
    nothing and spread the same way.  Everything else keeps salt 0 and is not repeated.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(part: float) -> int:
        return max(2, min(MOST_PIECES, round(PIECES * tasks * part)))

    hot = {k: pieces(part) for k, part in hot_keys(rows, key, share)}
    wide = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for k, n in hot.items():
        wide = wide.when(F.col(key) == F.lit(k), F.lit(n).cast("bigint"))
    left = rows.withColumn("_wide", F.when(F.col(key).isNull(), F.lit(PIECES * tasks).cast("bigint")).otherwise(wide))
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(row_id), "_wide"), F.lit(0).cast("bigint"))).drop("_wide")
    right = lookup.withColumn("_wide", F.coalesce(wide, F.lit(1).cast("bigint")))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_wide") - 1))).drop("_wide")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
