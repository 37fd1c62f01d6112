"""Line dedup by pairwise alignment.

Overlapping documents are found through rare keys of their lines: a window is a shortest run of lines that follow one another and have enough
words, keyed by its content and by how many like it stand before it in its document.  The first document that holds a key is the one that
every later holder is paired with, so a key in n documents gives n - 1 pairs, however frequent it is, and every common block of enough
words nominates the pair that it is common to.

A pair is aligned by patience diff.  Aligned blocks of enough words go from the later document.  Lines that the diff leaves apart, as
no line between two anchors is unique in both or as blocks stand in another order, are held against what is left of the earlier document,
block by block.  Pairs of equal texts are aligned once.  Line lists hold hashes only; texts move once, to meet their deletions.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from noteweave.llm.columns import unused
from noteweave.llm.storage import stored

#: Fewest words of a block that is deleted.
MIN_WORDS = 8
BLANK = " \t\n\x0b\f\r"


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails, ends, back = [], [], []
    for at, value in enumerate(values):
        n = bisect_left(tails, value)
        tails[n : n + 1] = [value]
        ends[n : n + 1] = [at]
        back.append(ends[n - 1] if n else -1)
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: index pairs of aligned equal items, rising in both."""
    pairs, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[n]: n for n in range(b0, b1) if count_b[b[n]] == 1}
        both = [(n, where[a[n]]) for n in range(a0, a1) if count_a[a[n]] == 1 and a[n] in where]
        fixed = [both[n] for n in longest_rising([j for _, j in both])]
        if fixed:
            pairs += fixed
            edges = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
            ranges += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


def windows(hashes: np.ndarray, words: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(begin, end, hash, words, number) of the windows: shortest runs of lines with ``min_words`` from their first or to their last line.

    Which runs are windows depends on their lines only.  ``number`` counts the windows of equal lines before this one.
    """
    import xxhash

    total, least = np.concatenate([[0], np.cumsum(words, dtype=np.int64)]), max(min_words, 1)
    ends = np.searchsorted(total, total[:-1] + least, "left")
    begins = np.searchsorted(total, total[1:] - least, "right") - 1
    spans = {(b, e) for b, e in enumerate(ends.tolist()) if e < len(total)} | {(b, e) for e, b in enumerate(begins.tolist(), 1) if b >= 0}
    lines = np.ascontiguousarray(np.stack([hashes, words], axis=1).astype(np.int64)).tobytes()
    before, out = Counter(), []
    for b, e in sorted(spans):
        content = xxhash.xxh64_intdigest(lines[16 * b : 16 * e]) - (1 << 63), int(total[e] - total[b])
        out.append((b, e, *content, before[content]))
        before[content] += 1
    return out


def shortest_runs(words: list[int], min_words: int) -> list[int]:
    """End of the shortest run with ``min_words`` words from each line on; 0 where there is none."""
    out, end, total = [], 0, 0
    for begin, n in enumerate(words):
        while total < min_words and end < len(words):
            total += words[end]
            end += 1
        out.append(end if total >= min_words else 0)
        total -= n
    return out


def common_blocks(later: list, earlier: list, later_words: list[int], earlier_words: list[int], min_words: int) -> list[int]:
    """Positions in ``later`` of the blocks of ``min_words`` or more words that it has in common with ``earlier``; each line of either is used once."""
    used, met, gone = [False] * len(later), [False] * len(earlier), []

    def take(i: int, j: int, n: int) -> None:
        used[i : i + n], met[j : j + n] = [True] * n, [True] * n
        gone.extend(range(i, i + n))

    pairs, at = align(later, earlier), 0
    while at < len(pairs):
        end = at + 1
        while end < len(pairs) and pairs[end][0] == pairs[end - 1][0] + 1 and pairs[end][1] == pairs[end - 1][1] + 1:
            end += 1
        i, j = pairs[at]
        if sum(later_words[i : i + end - at]) >= min_words:
            take(i, j, end - at)
        at = end
    if all(used):
        return gone
    # What the diff leaves apart, in the order of the later document.
    where: dict[tuple, list[int]] = {}
    for j, end in enumerate(shortest_runs(earlier_words, min_words)):
        if end and not any(met[j:end]):
            where.setdefault(tuple(earlier[j:end]), []).append(j)
    for places in where.values():
        places.reverse()  # the first place is taken from the end
    for i, end in enumerate(shortest_runs(later_words, min_words)):
        places = where.get(tuple(later[i:end]), ()) if end and not any(used[i:end]) else ()
        while places and any(met[places[-1] : places[-1] + end - i]):
            places.pop()
        if places:
            j, n = places.pop(), end - i
            while i + n < len(later) and j + n < len(earlier) and later[i + n] == earlier[j + n] and not (used[i + n] or met[j + n]):
                n += 1
            take(i, j, n)
    return sorted(gone)


def line_key(doc: Column, text: Column) -> Column:
    """Order of the documents: ascending doc, nulls last, then by a hash of the text."""
    return F.struct(doc.isNull().alias("none"), doc.alias("doc"), F.xxhash64(text).alias("text_hash"))


def nominated(rows: DataFrame, min_words: int) -> DataFrame:
    """(k, earlier): every document and the hash of the text of each earlier document that is the first to hold one of its windows."""
    names = ["hash", "words", "number"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, of = [], []
            for n, (hashes, words) in enumerate(zip(batch.column(1), batch.column(2))):
                some = windows(hashes.values.to_numpy(), words.values.to_numpy(), min_words)
                found += [w[2:] for w in some]
                of += [n] * len(some)
            columns = [pa.array(values, pa.int64()) for values in zip(*found)] if found else [pa.array([], pa.int64())] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=["k", *names])

    # Stored, so that it is made once and the join below has plain exchanges on both sides: Spark can split a hot window.
    found = stored(rows.mapInArrow(cut, StructType([rows.schema["k"], *(StructField(n, LongType()) for n in names)])))
    repeated = stored(found.groupBy(*names).agg(F.min("k").alias("first"), F.max("k").alias("last")).where("first <> last").drop("last"))
    later = found.join(repeated, names).where(F.col("k") != F.col("first"))
    return later.select("k", F.col("first.text_hash").alias("earlier")).distinct()


def alignments(pairs: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """(later, earlier, gone): positions of the lines that go from the text ``later``, for pairs of text hashes."""
    wanted = stored(pairs.select(F.explode(F.array("later", "earlier")).alias("text_hash")).distinct())
    lines = rows.select(F.col("k.text_hash").alias("text_hash"), "hashes", "words").join(wanted, "text_hash", "left_semi")
    lines = stored(lines.dropDuplicates(["text_hash"]))
    met = pairs
    for side in ("earlier", "later"):
        met = met.join(lines.select(F.col("text_hash").alias(side), F.col("hashes").alias(f"{side}_hashes"), F.col("words").alias(f"{side}_words")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for a, a_words, b, b_words in zip(*(batch.column(n) for n in (2, 3, 4, 5))):
                a, a_words, b, b_words = (x.values.to_pylist() for x in (a, a_words, b, b_words))
                gone.append(common_blocks(list(zip(a, a_words)), list(zip(b, b_words)), a_words, b_words, min_words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["later", "earlier", "gone"])

    columns = ["later", "earlier", "later_hashes", "later_words", "earlier_hashes", "earlier_words"]
    return met.select(*columns).mapInArrow(run, "later long, earlier long, gone array<int>")


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with text less its repeated blocks, and n_lines and n_deleted (non-blank lines).

    Columns n_lines and n_deleted are replaced, all others are carried along under any name.  Earlier is the smaller doc (null last; equal docs
    by a hash of the text).  Rows equal in doc and text are one document: each keeps what it keeps.  A null text stays null with no lines; an
    empty or blank one stays as it is.  Repeats inside one document are kept: of a block that stands more often than in any earlier
    document, the occurrences beyond that number.  Lines are compared whole, by 64-bit hash and number of words (runs without white space).
    """
    key = line_key(F.col(doc), F.col(text).cast("string"))
    lines = F.expr(
        f"transform(filter(split(`{text}`, '\\n'), x -> x rlike '\\\\S'), x -> struct(xxhash64(x) AS hash, size(filter(split(x, '\\\\s+'), w -> w <> '')) AS words))"
    )
    parsed = docs.select(key.alias("k"), lines.alias("lines")).where("size(lines) > 0")
    rows = stored(parsed.select("k", F.col("lines.hash").alias("hashes"), F.col("lines.words").alias("words")))
    pairs = stored(nominated(rows, min_words))
    texts = stored(pairs.select(F.col("k.text_hash").alias("later"), "earlier").distinct())
    gone = pairs.withColumn("later", F.col("k.text_hash")).join(stored(alignments(texts, rows, min_words)), ["later", "earlier"])
    deleted = gone.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("gone"))).alias("at"))

    others = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    key_name, at_name = unused(docs.columns, "line key"), unused(docs.columns, "deleted at")
    met = docs.select(*(F.col(f"`{c}`") for c in others), key.alias(key_name)).join(deleted.withColumnsRenamed({"k": key_name, "at": at_name}), key_name, "left")
    fields = [docs.schema[c] if c != text else StructField(text, StringType()) for c in others]
    place = others.index(text)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_deleted = [], [], []
            for whole, gone in zip(batch.column(place).to_pylist(), batch.column(len(others)).to_pylist()):
                gone, at, kept = set(gone or ()), 0, []
                for line in (whole or "").split("\n"):
                    if line.strip(BLANK):
                        at += 1
                        if at - 1 in gone:
                            continue
                    kept.append(line)
                texts.append(whole if whole is None else "\n".join(kept))
                n_lines.append(at)
                n_deleted.append(len(gone))
            columns = [batch.column(n) if n != place else pa.array(texts, pa.string()) for n in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())], names=[*others, "n_lines", "n_deleted"])

    counts = [StructField("n_lines", LongType()), StructField("n_deleted", LongType())]
    return met.select(*(F.col(f"`{c}`") for c in others), at_name).mapInArrow(rebuild, StructType([*fields, *counts]))
