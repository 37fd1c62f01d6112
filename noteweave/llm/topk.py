"""Exact top-k by inner product with a bit-sliced index.

Quantised attributes of a block of rows are kept as slices: one bitmap per attribute and binary digit,
with a bit for each row.  A query multiplies and adds the slices with bitmap arithmetic, which gives the
slices of all scores of the block.  From the most significant slice downward the top rows are
selected; rows that tie at the boundary all have the same score and are resolved by the smaller id.

Rows and queries are dealt into tiles (cell of rows, cell of queries).  A tile returns its k best per
query; the k best of those are the result.  Work is rows x queries, as the task demands, memory is a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows of one index block and queries added up at once; both fit a core's cache.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 64
#: Most rows and queries of a tile, and the least number of cells of each.
CELL_ROWS, CELL_QUERIES, LEAST_CELLS = 65_536, 4096, (6, 4)
#: Vectors with a quantised component beyond this are scored in Python's integers, since slices could leave a long.
LARGEST = 1 << 26
#: Scores beyond a long are ordered by their digits: so many bytes, moved above zero.
WIDE, LONG = 48, (1 << 63) - 1


def pack_bits(flags: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) to words of 64 rows, row 0 in the lowest bit."""
    pad = -flags.shape[-1] % 64
    if pad:
        flags = np.concatenate([flags, np.zeros((*flags.shape[:-1], pad), bool)], axis=-1)
    return np.ascontiguousarray(np.packbits(flags, axis=-1, bitorder="little")).view("<u8")


def add_into(total: list[np.ndarray], at: int, part: list[np.ndarray]) -> None:
    """Bitmap addition: the number whose slices are ``part``, shifted by ``at``, onto ``total``."""
    carry = None
    for n in range(at, 1 << 30):
        bit = part[n - at] if n - at < len(part) else None
        if bit is None and carry is None:
            return
        if n == len(total):
            total.append(np.zeros_like(total[0] if total else bit))
        mine = total[n]
        if bit is None or carry is None:
            other = carry if bit is None else bit
            carry = mine & other
            total[n] = mine ^ other
        else:
            half = mine ^ bit
            both = mine & bit
            total[n] = half ^ carry
            carry = both | (half & carry)
        if n - at >= len(part) and not carry.any():
            return


def slices_of(values: np.ndarray) -> np.ndarray:
    """Slices (digits, attributes, words) of non-negative integers (rows, attributes)."""
    digits = max(1, int(values.max(initial=0)).bit_length())
    return np.stack([pack_bits(((values >> d) & 1).astype(bool).T) for d in range(digits)])


def score_slices(slices: np.ndarray, top: int, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Slices (queries, words) of sum(weight * value), and what to add to each query's scores.

    Values are 0 to ``top`` (all ones).  A negative weight takes the complement of the slices:
    -w * v = w * (top - v) - w * top.
    """
    digits, attributes, words = slices.shape
    size = np.abs(weights)
    bits = max(1, int(size.max(initial=0)).bit_length())
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    flip = np.where(weights < 0, ones, np.uint64(0))
    masks = [np.where((size >> b) & 1, ones, np.uint64(0)).astype(np.uint64) for b in range(bits)]
    total: list[np.ndarray] = [np.zeros((len(weights), words), np.uint64)]
    for b in range(bits):
        # All products with one binary digit of the weights have the same place value.
        part: list[np.ndarray] = [np.zeros((len(weights), words), np.uint64)]
        for a in range(attributes):
            if masks[b][:, a].any():
                add_into(part, 0, [(slices[d, a][None, :] ^ flip[:, a, None]) & masks[b][:, a, None] for d in range(digits)])
        add_into(total, b, part)
    return total, -np.where(weights < 0, size, 0).sum(axis=1) * top


def select_top(score: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows that are surely among the k best, and of those tied at the boundary."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for piece in reversed(score):
        with_bit = tied & piece
        count = np.bitwise_count(sure | with_bit).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(count <= k, sure | with_bit, sure)
        tied = np.where(count > k, with_bit, tied & ~piece)
    return sure, tied


def rows_of(bitmap: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` set rows of one bitmap."""
    out: list[int] = []
    for word in np.flatnonzero(bitmap):
        bits = int(bitmap[word])
        while bits and len(out) < most:
            out.append(64 * int(word) + (bits & -bits).bit_length() - 1)
            bits &= bits - 1
        if len(out) >= most:
            break
    return np.array(out, np.int64)


def top_of_block(ids, values, query_ids, queries, k):
    """(query number, id, score) of the k best rows of a block for each query; rows are sorted by id."""
    low = values.min(initial=0)
    slices = slices_of(values - low)
    top = (1 << len(slices)) - 1
    score, shift = score_slices(slices, top, queries)
    shift = shift + queries.sum(axis=1) * low
    allowed = np.repeat(pack_bits(np.ones((1, len(ids)), bool)), len(queries), axis=0)
    first, behind = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    for q in np.flatnonzero(first < behind):
        for row in range(first[q], behind[q]):
            allowed[q, row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
    sure, tied = select_top(score, allowed, k)
    out_q, out_row = [], []
    for q in range(len(queries)):
        best = rows_of(sure[q], k)
        best = np.concatenate([best, rows_of(tied[q], k - len(best))])
        out_q.append(np.full(len(best), q))
        out_row.append(best)
    at_q, at_row = np.concatenate(out_q), np.concatenate(out_row)
    word, bit = at_row >> 6, (at_row & 63).astype(np.uint64)
    scores = sum((((piece[at_q, word] >> bit) & np.uint64(1)).astype(np.int64) << n) for n, piece in enumerate(score))
    return at_q, ids[at_row], scores + shift[at_q]


def large_scores(query_ids, queries, ids, values, k: int) -> list[tuple[int, int, int]]:
    """(query number, id, score) of the k best rows for each query, in integers of any size."""
    out = []
    for q, (own, query) in enumerate(zip(query_ids.tolist(), queries)):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(query, value)), i) for i, value in zip(ids.tolist(), values) if i != own)
        out += [(q, i, -s) for s, i in scored[:k]]
    return out


def top_k(vectors: DataFrame, k: int, is_query: Column, *, scale: int = 256, row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows with the highest integer inner product for every query row.

    Returns query_id, rank (from 1), vec_id, score.  Ties go to the smaller id; fewer rows give fewer ranks.  Rows
    with the query's own id are no candidates for it.  Vectors that are null, or hold null or non-finite
    components, take no part; nor do rows without an id, which nothing could name.  Shorter
    vectors count as filled up with zeros.  A repeated query row counts once, repeated candidates as often as they occur.
    Components may be of any finite size; a score beyond a long has its rank, but is null.  Other columns are not read.
    """
    usable = vectors.select(F.col(row).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")).where(
        F.col("id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    )
    rows = usable.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "asks")
    asking = rows.where("asks").select("id", "vector").distinct()
    counts = usable.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    row_cells = max(LEAST_CELLS[0], -(-counts["n"] // CELL_ROWS))
    query_cells = max(LEAST_CELLS[1], -(-counts["q"] // CELL_QUERIES))
    dealt = F.xxhash64("id", "vector")
    left = asking.select(
        "id", "vector", F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1))).alias("row_cell"), F.pmod(dealt, F.lit(query_cells)).cast("int").alias("query_cell")
    )
    right = rows.select(
        "id", "vector", F.pmod(dealt, F.lit(row_cells)).cast("int").alias("row_cell"), F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))).alias("query_cell")
    )

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Ids and quantised components, as floating-point numbers without fractions."""
        column = table.column("vector").combine_chunks()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        values = np.zeros((len(column), int(lengths.max(initial=0))))
        values[np.arange(values.shape[1])[None, :] < lengths[:, None]] = np.floor(float(scale) * column.flatten().to_numpy())
        return table.column("id").to_numpy(), values

    def search(asks: pa.Table, has: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if asks.num_rows and has.num_rows:
            query_ids, queries = matrix(asks)
            ids, values = matrix(has)
            order = np.argsort(ids, kind="stable")
            ids, values = ids[order], values[order]
            width = max(queries.shape[1], values.shape[1])
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            values = np.pad(values, ((0, 0), (0, width - values.shape[1])))
            big, big_query = (np.abs(values) > LARGEST).any(axis=1), (np.abs(queries) > LARGEST).any(axis=1)
            slots = np.flatnonzero(~big_query)
            for begin in range(0, len(ids), BLOCK_ROWS):
                some_rows = begin + np.flatnonzero(~big[begin : begin + BLOCK_ROWS])
                for first in range(0, len(slots) if len(some_rows) else 0, BLOCK_QUERIES):
                    some = slots[first : first + BLOCK_QUERIES]
                    q, best, score = top_of_block(ids[some_rows], values[some_rows].astype(np.int64), query_ids[some], queries[some].astype(np.int64), k)
                    for column, got in zip(found, (some[q], best, score)):
                        column.append(got)
        columns = [np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in found]
        # Keep the k best of the tile's blocks.
        order = np.lexsort((columns[1], -columns[2], columns[0]))
        columns = [c[order] for c in columns]
        start = np.searchsorted(columns[0], columns[0], "left")
        keep = np.arange(len(order)) - start < k
        numbers, best, scores = (c[keep].tolist() for c in columns)
        if asks.num_rows and has.num_rows and (big.any() or big_query.any()):
            for asked, rows_asked in ((slots, np.flatnonzero(big)), (np.flatnonzero(big_query), np.arange(len(ids)))):
                more = large_scores(query_ids[asked], queries[asked], ids[rows_asked], values[rows_asked], k)
                numbers, best, scores = numbers + [int(asked[q]) for q, _, _ in more], best + [i for _, i, _ in more], scores + [x for _, _, x in more]
        beyond = [(x > LONG) - (x < -LONG) for x in scores]
        at = np.array(numbers, np.int64)
        return pa.table(
            {
                "query_id": pa.array(asks.column("id").to_numpy()[at] if len(at) else [], pa.int64()), "hash": pa.array(asks.column("hash").to_numpy()[at] if len(at) else [], pa.int64()),
                "vec_id": pa.array(best, pa.int64()), "beyond": pa.array(beyond, pa.int32()), "score": pa.array([None if b else x for x, b in zip(scores, beyond)], pa.int64()),
                "digits": pa.array([(x + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big") if b else None for x, b in zip(scores, beyond)], pa.binary()),
            }
        )

    schema = "query_id long, hash long, vec_id long, beyond int, score long, digits binary"
    left = left.withColumn("hash", F.xxhash64("id", "vector"))
    tiles = left.groupBy("row_cell", "query_cell").cogroup(right.groupBy("row_cell", "query_cell")).applyInArrow(search, schema)
    ranked = Window.partitionBy("query_id", "hash").orderBy(F.desc("beyond"), F.desc("score"), F.desc("digits"), F.asc("vec_id"))
    return (
        tiles.withColumn("rank", F.row_number().over(ranked).cast(IntegerType()))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
