"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into few segments, so that one segment of two close fingerprints differs in at most one bit.
Every segment is indexed once per bit with that bit left out (a one-wildcard variant); equal variants meet in one run of a
sorted partition and are verified on all bits.  With three segments of 64 bits this is certain up to five
differing bits.

Equal fingerprints are one entry of the index, so groups of copies cost nothing.  A long run
yields its closest links, which keep it connected, not all its pairs.  A run longer than a block is cut into blocks by
hash, and every pair of blocks is its own task, so no fingerprint is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from noteweave.llm.components import connected
from noteweave.llm.storage import stored

#: (lowest bit, bits) of the segments of each 64-bit word of a fingerprint.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
VARIANTS = 64
#: Largest distance at which one segment of a single word surely differs in at most one bit.
FARTHEST = 2 * len(SEGMENTS) - 1
#: Largest distance of candidates for similar documents; unlike texts share a variant by chance, but are hardly ever as close.
CLOSE = 10
#: Fingerprints compared in one task; the rest of a longer run goes to pairs of blocks.
BLOCK = 4096
#: Runs up to this length are compared pair by pair.
SHORT = 16
#: Nodes and shingle hashes of a block whose pairs are verified in one task, and sets of it that are held against one at once.
BLOCK_NODES, BLOCK_SHINGLES, SETS = 2048, 1 << 21, 256
#: Texts by hash that are broadcast at most.
SMALL = 2_000_000


def fingerprint(text: str | None, words: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> list[int]:
    """Unsigned 64-bit SimHash per seed over shingles of lower-cased (A-Z) words; 0 without words.

    A text of fewer words than a shingle has one shingle, the whole sequence.
    """
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * len(seeds)
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts])
    starts = (ends - [len(part) + 1 for part in parts]).tolist()
    last = (ends - 1).tolist()[words - 1 :] or [len(joined)]
    shingles = [joined[a:b] for a, b in zip(starts, last)]
    shingles = set(shingles) if distinct else shingles
    out, digest = [], xxhash.xxh64_digest
    for seed in seeds:
        hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
        bits = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big"))
    return out


def fingerprints(
    docs: DataFrame, *, words: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, text_hash, p0, p1, ...) of every row: a hash of the whole text and the words of its fingerprint, as signed numbers."""
    names = [f"p{n}" for n in range(len(seeds))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words, seeds, distinct) for t in batch.column(2)]
            table = np.array(prints, np.uint64).reshape(len(prints), len(seeds)).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(table[:, n])) for n in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc", "text_hash", *names])

    schema = StructType([StructField("doc", docs.schema[doc].dataType), *(StructField(n, LongType()) for n in ("text_hash", *names))])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc).alias("doc"), F.xxhash64(whole).alias("text_hash"), whole.alias("text")).mapInArrow(read, schema)


def variants(prints: DataFrame, words: int) -> DataFrame:
    """(key int, node, p0, ...): the one-wildcard variants of every segment."""
    keys = []
    for word in range(words):
        for low, bits in SEGMENTS:
            for bit in range(bits):
                rest = ((1 << bits) - 1) & ~(1 << bit)
                segment = F.shiftrightunsigned(f"p{word}", low).bitwiseAND(F.lit(rest).cast("long"))
                keys.append((segment + F.lit(len(keys) << 22)).cast("int"))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "node", *(f"p{n}" for n in range(words)))


def first_common_variant(differs: np.ndarray) -> np.ndarray:
    """Number of the first variant that two fingerprints share, from their exclusive or (rows, words)."""
    out, number = np.full(len(differs), -1), 0
    for word in range(differs.shape[1]):
        for low, bits in SEGMENTS:
            part = (differs[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
            count = np.bitwise_count(part)
            # With one bit set, part - 1 has as many bits as the place of that bit.
            place = np.where(count == 1, np.bitwise_count(part - (count == 1).astype(np.uint64)), 0).astype(np.int64)
            out = np.where((out < 0) & (count <= 1), number + place, out)
            number += bits
    return out


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def bytes_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that differ."""
    differs = a ^ b
    for step in (4, 2, 1):
        differs = differs | differs >> np.uint64(step)
    return np.bitwise_count(differs & np.uint64(0x0101010101010101)).sum(axis=-1, dtype=np.int32)


def closest_links(prints: np.ndarray, distance: int, between: Callable = bits_between) -> tuple[np.ndarray, np.ndarray]:
    """The links of a minimum spanning tree that are within ``distance``: index pairs.

    They connect whatever any chain of links within ``distance`` connects.
    """
    n = len(prints)
    best, parent, out = between(prints, prints[0]), np.zeros(n, np.int64), np.zeros(n, bool)
    out[0] = True
    best[0] = 1 << 20
    ones, others = [], []
    for _ in range(n - 1):
        at = int(best.argmin())
        if best[at] <= distance:
            ones.append(parent[at])
            others.append(at)
        out[at] = True
        best[at] = 1 << 20
        near = between(prints, prints[at])
        closer = (near < best) & ~out
        best[closer], parent[closer] = near[closer], at
    return np.array(ones, np.int64), np.array(others, np.int64)


def links_of_runs(keys: np.ndarray, prints: np.ndarray, distance: int, between: Callable = bits_between) -> tuple[np.ndarray, np.ndarray]:
    """Links (row pairs) inside runs of equal keys; rows are sorted by key.

    Links by bits are reported by the first variant in common only, others by every key in common.
    """
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cuts, len(keys)))
    length = np.repeat(size, size)
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero((length > 1) & (length <= SHORT))
    for step in range(1, SHORT):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        link = between(prints[at], prints[at + step]) <= distance
        if between is bits_between:
            # Two fingerprints meet in many runs; the first common one reports them.
            link[link] = first_common_variant(prints[at[link]] ^ prints[at[link] + step]) == keys[at[link]] >> 22
        ones.append(at[link])
        others.append(at[link] + step)
    for begin, n in zip(cuts[size > SHORT].tolist(), size[size > SHORT].tolist()):
        a, b = closest_links(prints[begin : begin + n], distance, between)
        ones.append(a + begin)
        others.append(b + begin)
    return np.concatenate(ones), np.concatenate(others)


def similar(mine: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of the sorted sets ``others`` has a Jaccard similarity of ``similarity`` or more with the sorted set ``mine``."""
    sizes = np.array([len(o) for o in others], np.int64)
    both = np.zeros(len(others), np.int64)
    some = np.flatnonzero(sizes) if len(mine) else np.zeros(0, np.int64)
    if len(some):
        joined = np.concatenate([others[n] for n in some])
        hit = mine[np.minimum(np.searchsorted(mine, joined), len(mine) - 1)] == joined
        both[some] = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
    return both >= similarity * (sizes + len(mine) - both)


def joining_links(
    prints: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], distance: int, similarity: float, between: Callable, begin: int = 0
) -> list[tuple[int, int]]:
    """Index pairs of similar sets that join all classes which any similar pair joins; each joins two, so there are fewer than classes.

    Pairs within a class are not looked at, nor pairs beyond ``distance``.  With ``begin``, one of the pair is below it and the other is not.
    """
    classes, out = classes.copy(), []
    for at in range(begin or len(prints) - 1):
        low = max(begin, at + 1)
        others = low + np.flatnonzero(classes[low:] != classes[at])
        others = others[between(prints[others], prints[at]) <= distance]
        for first in range(0, len(others), SETS):
            some = others[first : first + SETS]
            for other in some[similar(sets[at], [sets[n] for n in some], similarity)].tolist():
                if classes[other] != classes[at]:
                    classes[classes == classes[other]] = classes[at]
                    out.append((at, other))
    return out


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def link_fingerprints(prints: DataFrame, words: int, distance: int) -> DataFrame:
    """(a, b) links between nodes whose fingerprints (p0, ...) share a variant and differ in ``distance`` bits or fewer.

    ``node`` is a long and unique.  Long runs give the closest links only; these connect the same nodes.
    """
    return link_runs(variants(prints, words), words, distance)


def link_runs(keyed: DataFrame, words: int, distance: int, between: Callable = bits_between) -> DataFrame:
    """The links of ``link_fingerprints`` from rows (key, node, p0, ...): nodes of equal key within ``distance``."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType()), StructField("key", keyed.schema["key"].dataType), StructField("size", LongType())])
    key_type, key_numbers = (pa.int32(), np.int32) if isinstance(schema["key"].dataType, IntegerType) else (pa.int64(), np.int64)

    def found(a, b) -> pa.RecordBatch:
        columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), key_type), pa.nulls(len(a), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "size"])

    def named(keys, sizes) -> pa.RecordBatch:
        columns = [pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int64()), pa.array(keys, key_type), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "size"])

    def matrix(columns) -> np.ndarray:
        return np.stack([np.asarray(c).view(np.uint64) for c in columns], axis=1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of sorted rows; a run longer than a block is only named, with its length."""
        keys, nodes, table = np.zeros(0, key_numbers), np.zeros(0, np.int64), np.zeros((0, words), np.uint64)
        long_key, long_size = None, 0
        for batch in _with_end(batches):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy()])
                nodes = np.concatenate([nodes, batch.column(1).to_numpy()])
                table = np.concatenate([table, matrix([batch.column(2 + n).to_numpy() for n in range(words)])])
            if long_key is not None:
                more = int(np.searchsorted(keys, long_key, "right"))
                long_size += more
                keys, nodes, table = keys[more:], nodes[more:], table[more:]
                if not len(keys) and batch is not None:
                    continue
                yield named([long_key], [long_size])
                long_key = None
            if not len(keys):
                continue
            # The last run may go on in the next batch.
            end = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1], "left"))
            now, now_nodes, now_table = keys[:end], nodes[:end], table[:end]
            keys, nodes, table = keys[end:], nodes[end:], table[end:]
            if len(keys) > BLOCK:
                long_key, long_size = int(keys[0]), len(keys)
                keys, nodes, table = keys[:0], nodes[:0], table[:0]
            if len(now):
                names, size = np.unique(now, return_counts=True)
                if (size > BLOCK).any():
                    yield named(names[size > BLOCK], size[size > BLOCK])
                    whole = np.repeat(size <= BLOCK, size)
                    now, now_nodes, now_table = now[whole], now_nodes[whole], now_table[whole]
            if len(now):
                a, b = links_of_runs(now, now_table, distance, between)
                if len(a):
                    yield found(now_nodes[a], now_nodes[b])

    links_and_names = stored(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(scan, schema))
    links = links_and_names.where("key is null").select("a", "b")
    long = links_and_names.where("key is not null").select("key", "size")
    if long.limit(1).count():
        blocks = F.ceil(F.col("size") / (BLOCK // 2)).cast("int")
        values = [f"p{n}" for n in range(words)]
        dealt = (
            keyed.join(long, "key")
            .select("key", "node", *values, blocks.alias("blocks"))
            .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("key", "node", *values, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        )

        def compare(part: pa.Table) -> pa.Table:
            nodes = part.column("node").to_numpy()
            a, b = closest_links(matrix([part.column(v).to_numpy() for v in values]), distance, between)
            return pa.table({"a": pa.array(nodes[a], pa.int64()), "b": pa.array(nodes[b], pa.int64())})

        links = links.union(dealt.groupBy("key", "i", "j").applyInArrow(compare, StructType(schema.fields[:2])))
    return links


def links_left(keyed: DataFrame, roots: DataFrame, sets_of: Callable, words: int, distance: int, similarity: float, between: Callable) -> DataFrame | None:
    """(a, b): links of similar nodes of equal key that join the classes which ``roots`` (node, root) leaves apart; None if no key has any such.

    Only keys with more than SHORT nodes of several classes are read, as ``link_runs`` gives all the pairs of the others.  A node outside
    the largest class of its key meets all the others of the key, nodes of that class meet only those outside.  Both kinds are cut into blocks
    of bounded rows and bounded sets, and a pair of blocks is a task.  It verifies each pair on the sets (``sets_of`` nodes: node, shingles) and writes
    at most one link for each two classes that it joins: the output is linear in the rows however many pairs fail.
    """
    values = [f"p{n}" for n in range(words)]
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > SHORT).select("key")
    long = keyed.join(sizes, "key").join(roots.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left")
    long = stored(long.select("key", "node", F.coalesce("root", "node").alias("root"), *values))
    by_class = long.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = by_class.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1").select("key", "main")
    apart = stored(long.join(mixed, "key").withColumn("outside", F.col("root") != F.col("main")).drop("main"))
    if not apart.limit(1).count():
        return None
    met = stored(apart.join(sets_of(stored(apart.select("node").distinct())), "node"))
    load = F.greatest(F.count("*") / BLOCK_NODES, F.sum(F.size("shingles")) / BLOCK_SHINGLES)
    cut = met.groupBy("key", "outside").agg(F.ceil(load).cast("int").alias("blocks"))
    cut = cut.groupBy("key").agg(F.max(F.when(F.col("outside"), F.col("blocks"))).alias("outer"), F.max(F.when(~F.col("outside"), F.col("blocks"))).alias("inner"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    dealt = (
        met.join(cut, "key")
        .withColumn("mine", F.when(F.col("outside"), block("outer")).otherwise(F.col("outer") + block("inner")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("outside"), F.col("outer") + F.col("inner") - 1).otherwise(F.col("outer") - 1))))
        .select("key", "node", "root", "shingles", *values, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        low, high = part.column("i")[0].as_py(), part.column("j")[0].as_py()
        mine = part.column("mine").to_numpy()
        order = np.argsort(mine, kind="stable")
        nodes, classes = part.column("node").to_numpy()[order], part.column("root").to_numpy()[order]
        table = np.stack([part.column(v).to_numpy().view(np.uint64)[order] for v in values], axis=1)
        lists = part.column("shingles").combine_chunks()
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[ends[n] : ends[n + 1]] for n in order]
        begin = 0 if low == high else int((mine == low).sum())
        if low != high and begin in (0, len(nodes)):
            return
        found = np.array(joining_links(table, classes, sets, distance, similarity, between, begin), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(nodes[found[:, 0]], pa.int64()), pa.array(nodes[found[:, 1]], pa.int64())], names=["a", "b"])

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, StructType([StructField("a", LongType()), StructField("b", LongType())]))


def near_duplicates(docs: DataFrame, *, distance: int = 4, words: int = 4, seed: int = 42, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, fingerprint (16 hex digits), component_id (smallest doc reachable).

    Fingerprints link at ``distance`` (up to 5) or fewer differing bits; classes are the components of the links.  A null
    or wordless text has fingerprint zero and is linked like any other.  Repeated docs give a row each; a
    component whose docs are all null has a null id.  Other columns are not read.
    """
    if not 0 <= distance <= FARTHEST:
        raise ValueError(f"distance must be 0 to {FARTHEST}")
    marked = stored(fingerprints(docs, words=words, seeds=(seed,), doc=doc, text=text).select("doc", "p0"))
    entries = marked.groupBy("p0").agg(F.min("doc").alias("least")).withColumn("node", F.col("p0"))
    roots = connected(link_fingerprints(entries.select("node", "p0"), 1, distance)).withColumnRenamed("node", "linked")
    rooted = entries.join(roots, entries.node == roots.linked, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "component_id")
    return marked.join(classes, marked.p0 == classes.node, "left").select(
        F.col("doc").alias(doc), F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(words: int) -> str:
    """SQL over a column ``hashed`` (word hashes): the distinct 64-bit hashes of the shingles, sorted."""
    parts = ", ".join(f"get(hashed, i + {n})" for n in range(words))
    return f"array_sort(array_distinct(CASE WHEN size(hashed) > 0 THEN transform(sequence(0, greatest(size(hashed) - {words}, 0)), i -> xxhash64({parts})) ELSE array() END))"


#: Minima in one key of the index of similar documents, and the largest chance that the index misses a pair at the asked similarity.
MINIMA, MISSED = 3, 1e-7


def index_size(similarity: float) -> tuple[int, int]:
    """(keys, distance): so many keys of MINIMA minima that a pair at ``similarity`` shares none, or differs in more than
    ``distance`` of all minima, with a chance below MISSED each, wherever the two texts differ.
    """
    keys = 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-(similarity**MINIMA)))
    total, more, distance = keys * MINIMA, 1.0, -1
    while more > MISSED and distance < total:
        distance += 1
        more -= math.comb(total, distance) * (1 - similarity) ** distance * similarity ** (total - distance)
    return keys, distance


def minima(text: str, words: int, factors: np.ndarray) -> tuple[np.ndarray, int]:
    """For every factor the least product (modulo 2^64) with a shingle's hash: equal in two texts with a chance of the similarity
    of their shingle sets; and the SimHash of the set."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").split()
    shingles = {b" ".join(parts[n : n + words]) for n in range(max(1, len(parts) - words + 1))} if parts else ()
    if not shingles:
        return np.zeros(len(factors), np.uint64), 0
    digests = np.frombuffer(b"".join([xxhash.xxh64_digest(s) for s in shingles]), np.uint8).reshape(-1, 8)
    hashes = digests.reshape(-1).view(np.uint64)
    out, bits = np.full(len(factors), ~np.uint64(0)), np.zeros(64, np.int64)
    for n in range(0, len(hashes), 4096):  # a long text in slices
        out = np.minimum(out, (factors[:, None] * hashes[n : n + 4096]).min(axis=1))
        bits += np.unpackbits(digests[n : n + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return out, int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def with_minima(docs: DataFrame, keys: int, words: int, doc: str, text: str) -> tuple[DataFrame, int]:
    """(doc, text_hash, print, keys, p0, p1, ...) of every row, and the number of the p: SimHash, keys of the index and a byte of each minimum."""
    factors = np.random.default_rng(42).integers(0, 1 << 64, keys * MINIMA, np.uint64) | np.uint64(1)
    mixers = np.random.default_rng(43).integers(0, 1 << 64, (keys, MINIMA), np.uint64) | np.uint64(1)
    width = -(-len(factors) // 8)
    names = [f"p{n}" for n in range(width)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [minima(t.as_py(), words, factors) for t in batch.column(2)]
            least = np.array([m for m, _ in read], np.uint64).reshape(-1, len(factors))
            prints = pa.array(np.array([p for _, p in read], np.uint64).view(np.int64))
            # The number of the key parts keys of equal minima.
            key = (least.reshape(-1, keys, MINIMA) * mixers).sum(axis=2, dtype=np.uint64) + np.arange(keys, dtype=np.uint64)
            table = np.zeros((len(least), width * 8), np.uint8)
            table[:, : len(factors)] = least.astype(np.uint8)
            table = table.view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * keys), pa.array(key.reshape(-1).view(np.int64)))
            columns = [lists, *(pa.array(np.ascontiguousarray(table[:, n])) for n in range(width))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, *columns], names=["doc", "text_hash", "print", "keys", *names])

    schema = StructType([StructField("doc", docs.schema[doc].dataType), StructField("text_hash", LongType()), StructField("print", LongType()), StructField("keys", ArrayType(LongType())), *(StructField(n, LongType()) for n in names)])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc).alias("doc"), F.xxhash64(whole).alias("text_hash"), F.lower(whole).alias("text")).mapInArrow(read, schema), width


def similar_documents(docs: DataFrame, *, similarity: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc, text_hash, component (a number), component_id (smallest doc in it).

    Texts link when the Jaccard similarity of their sets of shingles of ``words`` words (lower-cased) is ``similarity`` or more.
    Candidates come from two indexes: the one-wildcard segments of the SimHash of these sets, up to CLOSE differing bits (sure up to FARTHEST), and, since
    about ten bits differ at 0.8, keys of three minima of the hashed shingles each, which a pair at ``similarity`` escapes with a chance below 2e-7, wherever the
    texts differ, closer ones more rarely.  Each link is verified exactly on the whole texts' shingles; in dense groups the closest links
    are verified first, then all pairs that these leave in different classes.  Equal texts are one node.  Wordless and null
    texts are alike.  A component whose docs are all null has a null id.  Other columns are not read.
    """
    keys, distance = index_size(similarity)
    read, width = with_minima(docs, keys, words, doc, text)
    marked = stored(read)
    values = [f"p{n}" for n in range(width)]
    nodes = marked.groupBy(F.col("text_hash").alias("node")).agg(F.min("doc").alias("least"), F.first("print").alias("print"), F.first("keys").alias("keys"), *(F.first(v).alias(v) for v in values))
    nodes = stored(nodes)
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *values)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(node, shingles) of these nodes only."""
        wanted = F.broadcast(wanted) if wanted.count() <= SMALL else wanted  # the size is checked before a broadcast
        whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
        linked = docs.select(F.xxhash64(whole).alias("node"), whole.alias("whole")).join(wanted, "node", "left_semi")
        hashed = linked.withColumn("hashed", F.expr("transform(filter(split(lower(whole), '\\\\s+'), x -> x <> ''), x -> xxhash64(x))"))
        return hashed.select("node", F.expr(shingle_set(words)).alias("shingles")).dropDuplicates(["node"])

    def verified(links: DataFrame) -> DataFrame:
        links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
        sets = sets_of(stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        pairs = links.join(sets.withColumnRenamed("shingles", "sa"), links.a == sets.node).drop("node")
        pairs = pairs.join(sets.withColumnRenamed("shingles", "sb"), pairs.b == sets.node).drop("node")
        both = F.size(F.array_intersect("sa", "sb"))
        alike = F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both"))
        return stored(pairs.withColumn("both", both).where(alike).select("a", "b"))

    # Trees can prefer pairs that fail: the classes that they leave apart are compared whole.
    close = link_fingerprints(nodes.select("node", F.col("print").alias("p0")), 1, CLOSE)
    tree = verified(close.union(link_runs(keyed, width, distance, bytes_between)))
    roots = stored(connected(tree))
    left = links_left(keyed, roots, sets_of, width, distance, similarity, bytes_between)
    if left is not None:
        roots = connected(tree.union(stored(left)))
    roots = roots.withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, nodes.node == roots.linked, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", F.col("root").alias("component"), "component_id")
    return marked.join(classes, marked.text_hash == classes.node, "left").select(F.col("doc").alias(doc), "text_hash", "component", "component_id")
