"""Membership filters: a Bloom bitmap as one value of the plan, tested inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key before rounding up to a power of two, and the bounds of a bitmap (as a power of two; 8 MB at most).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 10, 26
PROBES = (0, 32)


def _slot(hash_: Column, probe: int, bits: int) -> Column:
    return F.shiftrightunsigned(hash_, probe).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))


def bloom(keys: DataFrame, rows: int) -> tuple[Column, int]:
    """The bitmap over a table of hashes (one long column), as a scalar subquery, and its bits as a power of two.

    ``rows`` is the number of keys.  The bitmap is bounded: with more keys than it is made for it lets more rows pass, never fewer.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, (BITS_PER_KEY * max(rows, 1) - 1).bit_length()))
    name = keys.columns[0]
    slots = keys.select(F.explode(F.array(*(_slot(F.col(name), p, bits) for p in PROBES))).alias("slot"))
    one = F.lit(1).cast("bigint")
    words = slots.select(F.shiftright("slot", 6).alias("word"), F.call_function("shiftleft", one, F.col("slot").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    every = keys.sparkSession.range(1 << (bits - 6)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bit"))
    filled = words.union(every).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    return filled.agg(F.array_sort(F.collect_list(F.struct("word", "bit")))["bit"].alias("bitmap")).scalar(), bits


def might_hold(hash_: Column, bitmap: Column, bits: int) -> Column:
    """False only for hashes that are surely not among the keys."""
    held = F.lit(True)
    for probe in PROBES:
        slot = _slot(hash_, probe, bits)
        held = held & (F.bit_get(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return held
