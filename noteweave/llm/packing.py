"""Packing by power-of-two decomposition.

A document of n ids is cut into blocks of the longest length and then by the binary digits of
what is left (13 ids with 8 at most: 8, 4, 1).  Every piece is a sequence of its own: its length is a power of two, so nothing
is padded, and no sequence crosses documents.  Equal lengths form a bucket; a training batch is
taken from one bucket.

Cutting is a map over documents: no shuffle, memory bounded by a slice of texts and one document.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from noteweave.llm.tokens import slices, token_ids

SLICE_CHARACTERS = 1_000_000


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids, falling; ``longest`` is a power of two."""
    out = [longest] * (n // longest)
    rest = n % longest
    bit = longest >> 1
    while rest:
        if rest & bit:
            out.append(bit)
            rest ^= bit
        bit >>= 1
    return out


def pack(
    docs: DataFrame, tokenizer: str, *, longest: int = 2048, end_id: int | None = 1, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all documents: doc, start, length, ids, doc_tokens, bucket, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit; ``bucket`` is the binary logarithm of the length.
    ``end_id`` ends every document.  A null text counts as empty (with ``end_id`` one piece of
    one id, without none).  A null or repeated doc is packed like any other row.  Other columns of the
    input are not read.  ``sequence_id`` is unique, not dense.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    tail = b"" if end_id is None else array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = token_ids(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in slices(texts, SLICE_CHARACTERS):
                row, start, length, total, ids = [], [], [], [], []
                for at in range(low, high):
                    coded = coder.encode(texts[at] or "") + tail
                    n, begin = len(coded) // 4, 0
                    for size in binary_lengths(n, longest):
                        row.append(at)
                        start.append(begin)
                        length.append(size)
                        total.append(n)
                        ids.append(coded[4 * begin : 4 * (begin + size)])
                        begin += size
                long = [pa.array(x, pa.int64()) for x in (start, length, total)]
                bucket = pa.array([n.bit_length() - 1 for n in length], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), long[0], long[1], pa.array(ids, pa.binary()), long[2], bucket],
                    names=["doc", "start", "length", "ids", "doc_tokens", "bucket"],
                )

    schema = StructType(
        [
            StructField("doc", docs.schema[doc].dataType),
            StructField("start", LongType()),
            StructField("length", LongType()),
            StructField("ids", BinaryType()),
            StructField("doc_tokens", LongType()),
            StructField("bucket", IntegerType()),
        ]
    )
    pieces = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)
    return (
        pieces.withColumnRenamed("doc", doc)
        .withColumn("sequence_id", F.monotonically_increasing_id())
        .withColumn("offset", F.lit(0).cast("long"))
    )


def write_buckets(pieces: DataFrame, folder: str) -> None:
    """One folder per bucket, so that a reader takes batches of one length."""
    pieces.write.mode("errorifexists").partitionBy("bucket").parquet(folder)
