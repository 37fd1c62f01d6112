"""Filter interaction audit with a counting-Bloom duplicate prepass.

Every document gets a mask of the filters it fails.  Counts by mask are additive, and everything that an order of the filters
does to a part (kept, removed, redundant, lost, Shapley sums) follows from at most 2**filters counts.

The duplicate filter needs the smallest id of every text.  A first pass adds each text's hash to a counting Bloom sketch: tasks
count the slots that their texts touch, the counts of all tasks are merged by slot, and slots counted twice or more become one
bitmap.  A text with a slot counted once is guaranteed unique.  Only the other texts, possible repeats, are shuffled, grouped by
the full text to the smallest id; equal texts meet in the map tasks first, so a group of copies is one row a task.  The sketch decides
what is shuffled and never what is counted, so its size does not change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from noteweave.llm.storage import new_folder

FILTERS = "ABCDE"
#: Filters below read the text alone; the last one, repeats, reads the table.
REPEATED = FILTERS[-1]
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
CONTINUATION = bytes(range(0x80, 0xC0))
#: Counters per document before rounding up to a power of two, and the most counters (a bit each, once merged).
COUNTERS_PER_ROW, MOST_COUNTERS = 8, 1 << 29
#: Bits of one bitmap of ``bitmap_construct_agg``.
BITMAP = 15


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the text (UTF-8) fails A, B, C, D."""
    words = text.split()  # of bytes: at blanks and \t to \r
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return (
        (len(words) < FEWEST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def text_flags(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(doc, part, hash, mask) of every row: a map, text by text."""
    read = docs.select(
        F.col(doc).alias("doc"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(whole(text)).alias("hash"),
        whole(text).cast("binary").alias("text"),
    )

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([text_mask(value.as_buffer().to_pybytes()) for value in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], masks], names=["doc", "part", "hash", "mask"])

    schema = StructType([read.schema["doc"], StructField("part", StringType()), StructField("hash", LongType()), StructField("mask", IntegerType())])
    return read.mapInArrow(flag, schema)


def whole(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def probes(name: str, bits: int) -> list[Column]:
    """The two slots of a hash: its low bits, and as many of its high half."""
    return [F.shiftrightunsigned(name, shift).bitwiseAND(F.lit((1 << bits) - 1)) for shift in (0, 32)]


def counted_twice(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the slots that the hashes (column hash) touch twice or more, of 2**bits counters merged over all tasks.

    Returned to the driver as one bit a counter, a size fixed by ``bits``.
    """
    slots = hashes.select(F.explode(F.array(*probes("hash", bits))).alias("slot"))
    counters = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    position = F.col("slot").bitwiseAND(F.lit((1 << BITMAP) - 1))
    bitmaps = counters.groupBy(F.shiftright("slot", BITMAP).alias("block")).agg(F.bitmap_construct_agg(position).alias("bitmap"))
    out = np.zeros((1 << (bits - BITMAP), 1 << (BITMAP - 3)), np.uint8)
    for row in bitmaps.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bitmap"], np.uint8)
    return out.reshape(-1)


def possibly_repeated(bitmap: np.ndarray, bits: int, spark):
    """Whether a hash may occur more than once, as a function of its column; texts do not go through it."""
    shipped = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def possible(hashes: pd.Series) -> pd.Series:
        key, known = hashes.to_numpy().view(np.uint64), shipped.value
        hit = np.ones(len(key), bool)
        for shift in (0, 32):
            slot = ((key >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            hit &= ((known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)
        return pd.Series(hit)

    return possible


def mask_counts(
    docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", part: str = "source", most_counters: int = MOST_COUNTERS
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters they fail, and how many of them are labelled good and toxic.

    A null text counts as empty, a null part as the empty string.  A document without id repeats nothing, and nothing repeats it.  Rows
    equal in id and text do not repeat each other.  A document is good (toxic) if any label row of its id says so.  An empty
    table has no counts.  Other columns are not read.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "audit-flags")
    text_flags(docs, doc=doc, text=text, part=part).write.parquet(folder)
    flags = spark.read.parquet(folder)
    bits = max(BITMAP, (min(most_counters, COUNTERS_PER_ROW * flags.count()) - 1).bit_length())
    possible = possibly_repeated(counted_twice(flags, bits), bits, spark)

    texts = docs.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), whole(text).alias("text"))
    repeats = texts.where(possible(F.xxhash64("text")))
    firsts = repeats.groupBy("text").agg(F.min("doc").alias("doc")).select("doc", F.xxhash64("text").alias("hash"), F.lit(True).alias("first"))
    keyed = flags.where(F.col("doc").isNotNull()).withColumn("possible", possible(F.col("hash")))
    # A null hash matches nothing: guaranteed unique texts have no row among the firsts.
    asked = keyed.withColumn("hash", F.when(F.col("possible"), F.col("hash"))).join(firsts, ["doc", "hash"], "left")
    repeated = F.when(F.col("possible") & F.col("first").isNull(), 1 << FILTERS.index(REPEATED)).otherwise(0)
    judged = labels.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    marked = asked.select("doc", "part", F.col("mask").bitwiseOR(repeated).alias("mask")).join(judged, "doc", "left")
    nameless = flags.where(F.col("doc").isNull()).select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic"))
    rows = marked.select("part", "mask", "good", "toxic").union(nameless)
    total = {name: F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in ("good", "toxic")}
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), *total.values())


def order_effects(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each step of every order of the filters does to each part, from its counts by mask (at most 2**filters rows).

    A row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (long).  Of all orders, a
    filter comes first among the m that a document fails in one m-th, so shapley adds n * orders / m over the masks.
    """
    orders = ["".join(p) for p in permutations(filters)]
    entries = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries"))
    bit = f"shiftleft(1, instr('{filters}', letter) - 1)"
    steps = entries.select("part", "entries", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)")).withColumn("own", F.expr(bit))
    before = f"aggregate(sequence(1, step), 0, (a, i) -> a | shiftleft(1, instr('{filters}', substring(filter_order, i, 1)) - 1)) - own"
    steps = steps.withColumn("before", F.expr(before))

    def total(what: str, condition: str) -> Column:
        return F.expr(f"aggregate(entries, 0L, (a, e) -> a + CASE WHEN {condition} THEN {what} ELSE 0L END)")

    removed = "(e.mask & own) <> 0 AND (e.mask & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("e.n", "(e.mask & (own | before)) = 0").alias("kept"),
        total("e.n", removed).alias("removed"),
        total("e.n", "(e.mask & own) <> 0 AND (e.mask & before) <> 0").alias("redundant"),
        total("e.n", "e.mask = own").alias("unique_fails"),
        total("e.good", removed).alias("good_lost"),
        total("e.toxic", removed).alias("toxic_lost"),
        total(f"e.n * {len(orders)}L div bit_count(e.mask)", "(e.mask & own) <> 0").alias("shapley"),
    )
