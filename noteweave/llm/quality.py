"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs without ASCII white space, in one of ``BUCKETS`` buckets by hash.  Every bucket has a sparse random index vector with
a few entries of 1 and -1.  Its context vector is the sum of the index vectors of its neighbours, over all texts of the corpus: tasks
add up their texts, Spark adds up the tasks.  A document is pooled from the context vectors of its words: weighted mean and variance, likeness of
neighbours, number of words.  A two-layer network (numpy) is fitted on a bounded sample of labelled documents, and its
temperature on a part of the sample that the network has not seen, so that scores are probabilities.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from noteweave.llm.columns import unused

#: Buckets of words and dimensions of their vectors; fixed, so the table of all context vectors is 4 MB for any corpus.
BUCKETS, DIMENSIONS = 1 << 14, 32
#: Non-zero entries of an index vector, and neighbours on each side.
ENTRIES, WINDOW = 4, 2
#: Words taken at once from one text, and collected before they are added up.
CHUNK = 100_000
#: Labelled documents that the network is fitted on, taken by hash of their id, and the part kept for the temperature.
SAMPLE_ROWS, CALIBRATION = 20_000, 0.25
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 128, 3e-3, 1e-3, 5
#: Word weight: RARE / (RARE + the word's share of the corpus).
RARE = 1e-3
TEMPERATURES = np.geomspace(0.25, 8, 81)


class Words(dict):
    """Bucket of a word; remembers words, up to a bound."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        bucket = self[word] = zlib.crc32(word) & (BUCKETS - 1)
        return bucket

    def of(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign (buckets, entries) of the non-zero entries, the same in every process."""
    drawn = np.random.default_rng(SEED)
    places = np.argsort(drawn.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places.astype(np.int64), drawn.choice(np.array([-1.0, 1.0]), (BUCKETS, ENTRIES))


def add_contexts(total: np.ndarray, ids: np.ndarray, owner: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds the index vectors of each word's neighbours in its own text onto ``total`` (buckets * dimensions)."""
    places, signs = index
    for apart in range(1, WINDOW + 1):
        for low in range(0, len(ids) - apart, CHUNK):
            end = min(low + CHUNK, len(ids) - apart)
            same = owner[low:end] == owner[low + apart : end + apart]
            a, b = ids[low:end][same], ids[low + apart : end + apart][same]
            for word, other in ((a, b), (b, a)):
                cells = word[:, None].astype(np.int64) * DIMENSIONS + places[other]
                total += np.bincount(cells.ravel(), signs[other].ravel(), len(total))


def context_vectors(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(buckets, dimensions) sums of neighbours and (buckets) occurrences over all texts; what is collected has a fixed size."""
    names = [f"d{n}" for n in range(DIMENSIONS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, index = Words(), index_vectors()
        total, n = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
        held, size, owner = [], 0, 0

        def add() -> None:
            nonlocal held, size
            if held:
                ids = np.concatenate(held)
                n[:] += np.bincount(ids, minlength=BUCKETS)
                add_contexts(total, ids, np.repeat(np.arange(len(held)), [len(x) for x in held]), index)
            held, size = [], 0

        for batch in batches:
            for value in batch.column(0):
                held.append(words.of(value.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= CHUNK:
                    add()
        add()
        used = np.flatnonzero(n)
        sums = total.reshape(BUCKETS, DIMENSIONS)[used].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(c) for c in sums.T)], names=["bucket", "n", *names])

    texts = docs.where(F.col(text).isNotNull()).select(F.col(text).cast("string").cast("binary").alias("text"))
    parts = texts.mapInArrow(count, "bucket long, n long, " + ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *names))).toArrow()  # at most BUCKETS rows
    contexts, n = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    at = found.column("bucket").to_numpy()
    n[at] = found.column("n").to_numpy()
    contexts[at] = np.stack([found.column(c).to_numpy() for c in names], axis=1) if len(at) else 0
    return contexts, n


@dataclass
class Pooling:
    """Word vectors of length one less their common part, and weights of the words."""

    vectors: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, contexts: np.ndarray, n: np.ndarray) -> Pooling:
        vectors = contexts / np.maximum(np.linalg.norm(contexts, axis=1, keepdims=True), 1)
        share = n / max(n.sum(), 1)
        vectors = vectors - share @ vectors
        return cls(vectors.astype(np.float32), (RARE / (RARE + share)).astype(np.float32))

    def pool(self, ids: np.ndarray) -> np.ndarray:
        """Weighted mean and variance of a whole text's vectors, mean product of neighbours, log of its words."""
        dims = self.vectors.shape[1]
        mean, square, weight, likeness = np.zeros(dims), np.zeros(dims), 0.0, 0.0
        for low in range(0, len(ids), CHUNK):
            some = ids[max(low - 1, 0) : low + CHUNK]
            x = self.vectors[some]
            likeness += float((x[1:] * x[:-1]).sum())
            x, w = x[1 if low else 0 :], self.weights[some[1 if low else 0 :]]
            mean, square, weight = mean + w @ x, square + w @ (x * x), weight + float(w.sum())
        if weight:
            mean, square = mean / weight, square / weight
        return np.concatenate([mean, square - mean * mean, [likeness / max(len(ids) - 1, 1), np.log1p(len(ids))]])


@dataclass
class Network:
    """Standardised input, tanh layer, one logit divided by the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    offset: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.first + self.bias) @ self.second + self.offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Network:
        """Cross entropy by Adam with decayed weights; the temperature on every 1 / CALIBRATION-th row, which the weights do not see.

        With one label alone, or none, the score is the share of label 1, counted with one row of each more.
        """
        features = x.shape[1]
        held = np.arange(len(x)) % round(1 / CALIBRATION) == 0
        prior = (y.sum() + 1) / (len(y) + 2)
        net = cls(np.zeros(features), np.ones(features), np.zeros((features, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))))
        if len(np.unique(y[~held])) < 2:
            return net
        drawn = np.random.default_rng(SEED)
        net.centre, net.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
        z, t = (x[~held] - net.centre) / net.scale, y[~held]
        weights = [drawn.normal(0, features**-0.5, (features, HIDDEN)), np.zeros(HIDDEN), drawn.normal(0, HIDDEN**-0.5, HIDDEN), np.array(net.offset)]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(EPOCHS):
            order = drawn.permutation(len(z))
            for low in range(0, len(z), BATCH):
                at = order[low : low + BATCH]
                hidden = np.tanh(z[at] @ weights[0] + weights[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -50, 50))) - t[at]) / len(at)
                back = np.outer(error, weights[2]) * (1 - hidden * hidden)
                slopes = [z[at].T @ back + DECAY * weights[0], back.sum(axis=0), hidden.T @ error + DECAY * weights[2], error.sum()]
                step += 1
                for n, slope in enumerate(slopes):
                    m, v = moments[n] = 0.9 * moments[n][0] + 0.1 * slope, 0.999 * moments[n][1] + 0.001 * slope * slope
                    weights[n] = weights[n] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.first, net.bias, net.second, net.offset = weights[0], weights[1], weights[2], float(weights[3])
        logits, wanted = net.logits(x[held]), y[held]
        losses = [np.logaddexp(0, np.where(wanted == 1, -logits, logits) / t).mean() for t in TEMPERATURES]
        net.temperature = float(TEMPERATURES[int(np.argmin(losses))])
        return net


@dataclass
class Classifier:
    pooling: Pooling
    network: Network

    def pooled(self, texts: list[bytes], words: Words) -> np.ndarray:
        return np.stack([self.pooling.pool(words.of(t)) for t in texts])


def text_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def pooled_sample(docs: DataFrame, labels: DataFrame, learn: Column, pooling: Pooling, sample_rows: int, doc: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pooled vectors and labels of about ``sample_rows`` labelled documents, one text each, in the order of their hash."""
    judged = labels.where(F.col("quality").isin(0, 1) & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc"))
    clear = judged.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    clear = clear.withColumn("hash", F.xxhash64(F.col("doc").cast("string")))
    rows = docs.select(F.col(doc).alias("doc"), text_bytes(text).alias("text"), learn.alias("learn")).where("learn").drop("learn")
    share = min(1.0, sample_rows / max(clear.count(), 1))
    chosen = clear.where(F.shiftrightunsigned("hash", 11) / float(1 << 53) < share)  # about sample_rows at most
    # Rows of one id are one document here: each task passes on one of its texts.
    texts = rows.join(F.broadcast(chosen), "doc").groupBy("doc", "quality", "hash").agg(F.min("text").alias("text"))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            vectors = [pooling.pool(words.of(v.as_buffer().to_pybytes())) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64()))], names=["hash", "quality", "vector"])

    found = texts.select("hash", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(pool, "hash long, quality int, vector array<double>").toArrow()
    found = found.sort_by("hash")
    features = 2 * DIMENSIONS + 2
    return found.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, features), found.column("quality").to_numpy()


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, sample_rows: int = SAMPLE_ROWS, doc: str = "doc_id", text: str = "text") -> Classifier:
    """Word vectors of all texts of ``docs``, and a network fitted on labelled rows where ``learn`` holds.

    ``labels`` has ``doc`` and quality (0 or 1; others, null and contradictory ones teach nothing).  The sample is bounded: about
    ``sample_rows`` documents by a hash of their id, whatever the size of the tables; of rows with equal id one is learnt from.
    """
    pooling = Pooling.of(*context_vectors(docs, text=text))
    x, y = pooled_sample(docs, labels, learn, pooling, sample_rows, doc, text)
    return Classifier(pooling, Network.fit(x, y.astype(float)))


def score(docs: DataFrame, classifier: Classifier, *, text: str = "text", out: str = "score") -> DataFrame:
    """The rows of ``docs`` with ``out``, a probability; a column of that name is replaced, all others are carried along.

    A null text counts as empty; texts without words have a score too.  A map over rows: no shuffle; the classifier (2 MB) goes to
    each executor once.
    """
    kept = [f for f in docs.schema.fields if f.name != out]
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = Words(), shipped.value
        for batch in batches:
            texts = [v.as_buffer().to_pybytes() for v in batch.column(len(kept))]
            scores = model.network.scores(model.pooled(texts, words)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(scores)], names=[*(f.name for f in kept), out])

    schema = StructType([*kept, StructField(out, DoubleType())])
    return docs.select(*(F.col(f"`{f.name}`") for f in kept), text_bytes(text).alias(unused(docs.columns, "text read"))).mapInArrow(predict, schema)
