"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bit per language in every slot.  An n-gram addresses two
slots; the conjunction of their masks holds every language that may contain it.  A text's n-grams are counted per
language from these masks; the counts are corrected for the false positives that the filter's filling
predicts, and the largest decides.

Fitting: n-grams are counted on a bounded sample of labelled rows.  A language holds an n-gram
that makes up at least ``LEAST_RATE`` of its n-grams and ``LEAST_SHARE`` of the n-gram's best rate in any language, so
passages in a foreign language do not teach theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from noteweave.llm.columns import unused
from noteweave.llm.tokens import slices

SIZE = 4
SLICE_CHARACTERS = 500_000
#: Rows per language that the filter is fitted on, taken by hash of the row's key.
SAMPLE_ROWS = 4000
#: Labels that are learnt at most, by their rows; each takes a bit of every slot.
MOST_LANGUAGES = 4096
LEAST_RATE, LEAST_SHARE = 2e-6, 0.2
#: Slots per held n-gram of the fullest language, before rounding up to a power of two.
SLOTS_PER_GRAM = 16
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd constants of multiplicative hashing

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether a code point is a letter; made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that begin with a letter, the text each belongs to, and letters per text.

    Letters are lower-cased, everything else counts as a blank; texts do not run into each other.
    """
    lowered = [text.lower() for text in texts]
    points = np.frombuffer((" " * SIZE).join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([points, np.full(SIZE, 32, np.uint32)])
    letter = letter_table()[points]
    plain = np.where(letter, points, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + SIZE for t in lowered])[at]
    key = np.zeros(len(at), np.uint64)
    for n in range(SIZE):
        key = (key ^ plain[at + n]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    return key, owner, np.bincount(owner, minlength=len(texts))


def slot(key: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return ((key * np.uint64(MULTIPLIERS[probe])) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Filters:
    """``masks`` (words, slots): bit l of word l // 64 says that language l addresses the slot."""

    languages: list[str]
    masks: np.ndarray
    bits: int

    def __post_init__(self):
        filled = [float(((self.masks[n >> 6] >> np.uint64(n & 63)) & np.uint64(1)).mean()) for n in range(len(self.languages))]
        self.chance = np.square(np.minimum(filled, 0.99))

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (share of the n-grams that it explains, corrected) of each text."""
        names, scores = [], []
        for low, high in slices(texts, SLICE_CHARACTERS):
            key, owner, n = grams(texts[low:high])
            first, second = slot(key, 0, self.bits), slot(key, 1, self.bits)
            estimate = np.zeros((len(self.languages), high - low))
            for language, chance in enumerate(self.chance):
                if not language & 63:
                    masks = self.masks[language >> 6][first] & self.masks[language >> 6][second]
                hits = np.bincount(owner, (masks >> np.uint64(language & 63)) & np.uint64(1), minlength=high - low)
                estimate[language] = np.maximum(0, (hits - n * chance) / (1 - chance))
            best = estimate.argmax(axis=0) if len(self.languages) else np.zeros(high - low, int)
            for text in range(high - low):
                known = n[text] > 0 and bool(self.languages)
                names.append(self.languages[best[text]] if known else "und")
                scores.append(min(1.0, estimate[best[text], text] / n[text]) if known else 0.0)
        return names, np.array(scores, float)


def fit(docs: DataFrame, labelled: Column, *, sample_rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters learnt from rows where ``labelled`` holds and lang and text are not null.

    The sample is bounded: about ``sample_rows`` rows per language, by a hash of doc, whatever the size of the
    table, of the ``most_languages`` most frequent labels.  What is collected is bounded by it too: one mask for each slot that an n-gram addresses.
    """
    rows = docs.select(F.xxhash64(F.col(doc).cast("string")).alias("hash"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), labelled.alias("use"))
    rows = rows.where(F.col("use") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Filters([], np.zeros((1, 2), np.uint64), 1)
    languages = sorted(sizes)
    # Hashes are uniform, so a limit on them takes the wanted share of each language.
    share = docs.sparkSession.createDataFrame([(name, min(1.0, sample_rows / n)) for name, n in sizes.items()], "lang string, share double")
    uniform = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    sample = rows.join(F.broadcast(share), "lang").where(uniform < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(names):
                mine = [t for t, l in zip(texts, names) if l == name]
                for low, high in slices(mine, SLICE_CHARACTERS):
                    key, n = np.unique(grams(mine[low:high])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()), StructField("n", LongType())])
    counted = sample.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    rated = counted.withColumn("rate", rate).withColumn("best", F.max("rate").over(Window.partitionBy("gram")))
    held = rated.where((F.col("rate") >= LEAST_RATE) & (F.col("rate") >= LEAST_SHARE * F.col("best"))).select("lang", "gram")
    found = held.groupBy("gram").agg(F.collect_list("lang").alias("langs")).toArrow()  # bounded by the sample
    number = {name: n for n, name in enumerate(languages)}
    owners = found.column("langs").combine_chunks()
    width = owners.value_lengths().to_numpy(zero_copy_only=False)
    key = np.repeat(found.column("gram").to_numpy().view(np.uint64), width)
    language = np.array([number[name] for name in owners.flatten().to_pylist()], np.int64)
    fullest = int(np.bincount(language, minlength=1).max(initial=1))
    bits = max(10, int(SLOTS_PER_GRAM * fullest - 1).bit_length())
    masks = np.zeros((1 + (len(languages) - 1) // 64, 1 << bits), np.uint64)
    for probe in (0, 1):
        np.bitwise_or.at(masks, (language >> 6, slot(key, probe, bits)), np.uint64(1) << (language & 63).astype(np.uint64))
    return Filters(languages, masks, bits)


def identify(docs: DataFrame, filters: Filters, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; columns of these names are replaced.

    ``und`` and score 0 if the text is null or has no letter.  Other columns are carried along and no input of
    the prediction.  A map over rows: no shuffle; the filters go to each executor once.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    shipped = docs.sparkSession.sparkContext.broadcast(filters)
    # A text that is carried along anyway is sent once.
    carried = [n for n, f in enumerate(kept) if f.name == text and isinstance(f.dataType, StringType)]
    place = carried[0] if carried else len(kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shipped.value.judge([t or "" for t in batch.column(place).to_pylist()])
            columns = [batch.column(n) for n in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores)], names=[*(f.name for f in kept), "lang_pred", "score"])

    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    read = docs.select(*(F.col(f"`{f.name}`") for f in kept), *([] if carried else [F.col(text).cast("string").alias(unused(docs.columns, "text read"))]))
    return read.mapInArrow(predict, schema)
