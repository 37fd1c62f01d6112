"""Token ids as fixed-stride shards in training order.

Documents, each closed by an end id, run one after the other along their partition and are cut into sequences of a
fixed number of ids; the last one of a partition is padded.  They are encoded once, into a stored, compressed table of sequences
numbered within their partition; the counts of that table give every sequence a dense index.  A keyed Feistel network permutes the
indices, and a value outside the range walks its cycle until it is inside: each sequence knows its global slot without a sort.  Sequences
move once, compressed, to ranges of slots; each range is one file: record r of shard s is slot s * per_shard + r, at byte r * stride.

A record is the ids as little-endian unsigned 16-bit numbers and one separator byte.  The files are written by
Spark's text sink, from raw bytes, so its commit protocol holds for lost executors and on any file system.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from noteweave.llm.storage import dropped, stored
from noteweave.llm.tokens import token_ids

ROUNDS = 4  # even, so that both halves have their first width again
#: Steps of a walk.  Fewer than half of the values are outside, so a longer walk has a chance of 2**-WALK.
WALK = 128
SEPARATOR = "\n"
#: Ids that a task gathers before it passes sequences on.
FLUSH_IDS = 500_000
#: Columns of a stored sequence, and the level of compression of one that moves.
SEQUENCE = ["partition", "number", "doc", "start", "n_ids", "record"]
LEVEL = 3
#: How the stored sequences are compressed.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5"}
#: Partitions of the first level of counts, and most whose counts are broadcast.
BLOCK, MOST_PARTITIONS = 4096, 1_000_000


@dataclass(frozen=True)
class Layout:
    """What a reader must know of a folder of shards."""

    sequences: int
    ids: int
    per_shard: int
    seed: int

    @property
    def stride(self) -> int:
        return 2 * self.ids + len(SEPARATOR)


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest network over at least n values."""
    bits = max(2, (n - 1).bit_length())
    return bits - bits // 2, bits // 2


def permute_once(value: Column, n: int, seed: int) -> Column:
    """One pass of the keyed network; the halves may differ by a bit and swap their widths each round."""
    wide, narrow = widths(n)
    left, right = F.shiftrightunsigned(value, narrow), value.bitwiseAND(F.lit((1 << narrow) - 1).cast("long"))
    for turn in range(ROUNDS):
        mask = F.lit((1 << wide) - 1).cast("long")
        left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(seed), F.lit(turn)).bitwiseAND(mask))
        wide, narrow = narrow, wide
    return F.shiftleft(left, narrow).bitwiseOR(right)


def with_slot(df: DataFrame, index: str, slot: str, n: int, seed: int) -> DataFrame:
    """Adds the slot of a dense index: a permutation of 0 to n - 1 by cycle-walking."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)),
        permute_once(F.col(index), n, seed),
        lambda at, _: F.when(at < n, at).otherwise(permute_once(at, n, seed)),
    )
    ended = F.when(F.col(slot) < n, F.col(slot)).otherwise(F.raise_error(F.lit("a walk did not end; take another seed")).cast("long"))
    return df.withColumn(slot, walk).withColumn(slot, ended)


def sequences(docs: DataFrame, tokenizer: str, ids: int, pad_id: int, end_id: int) -> DataFrame:
    """(partition, number, doc, start, n_ids, record) of ``docs`` (doc, text): the sequences of each partition from 0, and the doc of their first
    id with the ids of that doc in front of it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(tokenizer)
        held, keys, begins, size = [], [], [], 0  # documents not yet passed on, and where they begin among the held ids
        number, ahead, partition = 0, 0, TaskContext.get().partitionId()

        def rows(stream: np.ndarray, whole: int) -> pa.RecordBatch:
            count = -(-whole // ids)
            starts = np.arange(count) * ids
            owner = np.searchsorted(begins, starts, "right") - 1
            records = [stream[at : at + ids].tobytes() for at in starts.tolist()]
            columns = [
                pa.array([partition] * count, pa.int32()), pa.array(np.arange(number, number + count)), pa.array([keys[n] for n in owner], key_type),
                pa.array(starts - np.array(begins, np.int64)[owner] + np.where(owner == 0, ahead, 0)), pa.array(np.minimum(ids, whole - starts).astype(np.int32)), pa.array(records, pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=SEQUENCE)

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                coded = coder.ids(text.as_py() or "")
                keys.append(key)
                begins.append(size)
                held.append(np.fromiter(coded, "<u2", len(coded)))
                held.append(np.array([end_id], "<u2"))
                size += len(coded) + 1
                if size >= FLUSH_IDS + ids:
                    stream, whole = np.concatenate(held), size // ids * ids
                    yield rows(stream, whole)
                    # What is left belongs to the last documents; of the first of them ``ahead`` ids are gone.
                    first = int(np.searchsorted(begins, whole, "right")) - 1
                    ahead = whole - begins[first] + (ahead if first == 0 else 0)
                    number += whole // ids
                    held, size = [stream[whole:]], size - whole
                    keys, begins = keys[first:], [0, *(b - whole for b in begins[first + 1 :])]
                    if not size:
                        keys, begins, ahead = [], [], 0
        if size:
            stream = np.concatenate([*held, np.full(-size % ids, pad_id, "<u2")])
            yield rows(stream, size)

    types = (IntegerType(), LongType(), docs.schema["doc"].dataType, LongType(), IntegerType(), BinaryType())
    return docs.mapInArrow(cut, StructType([StructField(n, t) for n, t in zip(SEQUENCE, types)]))


def with_index(rows: DataFrame) -> DataFrame:
    """Adds ``index``, dense over all partitions: a partition's number plus the sequences of the partitions before it.

    The counts are one row per partition, added up in two levels; the data is neither sorted nor moved.
    """
    counts = stored(rows.groupBy("partition").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"partition div {BLOCK}")))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("block", "n"))).scalar()
    inside = Window.partitionBy("block").orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    before = F.aggregate(F.filter("blocks", lambda b: b["block"] < F.col("block")), F.lit(0).cast("long"), lambda total, b: total + b["n"])
    base = counts.select("*", blocks.alias("blocks")).select("partition", (F.coalesce(F.sum("n").over(inside), F.lit(0)) + before).alias("base"))
    base = F.broadcast(base) if counts.count() <= MOST_PARTITIONS else base  # 12 bytes each
    return rows.join(base, "partition").withColumn("index", F.col("base") + F.col("number")).drop("base")


def recoded(rows: DataFrame, pack: bool) -> DataFrame:
    """The rows (shard, slot, record) with compressed records, or with plain ones again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        change = zstandard.ZstdCompressor(level=LEVEL).compress if pack else zstandard.ZstdDecompressor().decompress
        for batch in batches:
            records = pa.array([change(r.as_buffer()) for r in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), records], names=["shard", "slot", "record"])

    return rows.mapInArrow(run, "shard long, slot long, record binary")


def materialise(
    docs: DataFrame, tokenizer: str, folder: str, *, ids: int = 2048, per_shard: int = 4096, seed: int = 11, end_id: int = 50256,
    pad_id: int = 50256, doc: str = "doc_id", text: str = "text",
) -> Layout:
    """Write ``folder``/shards and ``folder``/index, and return the layout (also in ``folder``/layout).

    ``folder`` must be new and on a file system that all executors share.  Ids must fit 16 bits.  The index has a row per sequence: slot, doc and start of its
    first id (how many ids of that doc stand before), n_ids without padding.  A null text is an empty document of one id.  An empty
    table gives no record.  Null and repeated docs are written like any other; other columns are not read.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    # Encoded once: what follows reads this table, so a lost executor does not change which rows are where.
    sequences(narrow, tokenizer, ids, pad_id, end_id).write.options(**PACKED).parquet(f"{folder}/sequences")
    cut = spark.read.parquet(f"{folder}/sequences")
    layout = Layout(cut.count(), ids, per_shard, seed)
    n = max(1, layout.sequences)
    placed = with_slot(with_index(cut), "index", "slot", n, seed)
    placed.select("slot", F.col("doc").alias(doc), "start", "n_ids").write.parquet(f"{folder}/index")

    dealt = placed.select(F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), "slot", "record")
    moved = recoded(dealt, pack=True).repartition("shard")
    records = recoded(moved, pack=False).sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))  # the bytes as they are
    records.write.partitionBy("shard").option("lineSep", SEPARATOR).text(f"{folder}/shards")
    spark.createDataFrame([(json.dumps(asdict(layout)),)], "value string").coalesce(1).write.text(f"{folder}/layout")
    dropped(spark, f"{folder}/sequences")
    return layout


def read_layout(spark: SparkSession, folder: str) -> Layout:
    return Layout(**json.loads(spark.read.text(f"{folder}/layout").first()[0]))


def read_slots(spark: SparkSession, folder: str, layout: Layout, first: int = 0, end: int | None = None) -> DataFrame:
    """(slot, shard, offset, record) of the slots from ``first`` up to ``end``; only their shards are opened.

    A reader that stopped resumes at its next slot; offset is the record's byte in its shard.
    """
    end = layout.sequences if end is None else min(end, layout.sequences)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    low, high = first // layout.per_shard, max(0, end - 1) // layout.per_shard
    wanted = files.where(F.col("shard").between(low, high)).select(F.col("shard").cast("long").alias("shard"), "content")
    whole = F.floor(F.octet_length("content") / layout.stride).cast("int")
    rows = wanted.where(whole > 0).select("shard", "content", F.explode(F.sequence(F.lit(0), whole - 1)).alias("r"))
    rows = rows.select(
        (F.col("shard") * layout.per_shard + F.col("r")).alias("slot"),
        "shard",
        (F.col("r").cast("long") * layout.stride).alias("offset"),
        F.substring("content", F.col("r") * layout.stride + 1, F.lit(2 * layout.ids)).alias("record"),
    )
    return rows.where(F.col("slot").between(first, end - 1))
