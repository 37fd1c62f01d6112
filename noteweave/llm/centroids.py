"""Centroid clustering by the threshold algorithm, in exact integers.

Each dimension keeps its centroids in a sorted list.  For a vector the lists are walked outward from its value, all dimensions
in step: the entry next to the walked part, on the nearer side, is the dimension's frontier.  A centroid met for the first time
gets its exact distance.  The frontier distances squared add up to a threshold that no centroid unseen so far can undercut; the walk
of a vector stops when the threshold strictly exceeds its best exact distance, so ties are met too.

A round reads the vectors once, as a map.  A task returns sums and counts of its clusters; Spark adds them up, and the driver sees one number per
cluster, dimension and limb.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from noteweave.llm.storage import stored

#: Vectors walked at once.
BLOCK = 1024
#: Integers beyond 2**LIMB are summed as digits of base 2**LIMB.
LIMB = 40
LARGEST = (1 << 63) - 1


def quantise(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of float64 (rows, dimensions): int64, or Python integers if a number is too large for it."""
    floors = np.floor(scale * vectors)
    if np.abs(floors).max(initial=0) < 2.0**62:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors], dtype=object).reshape(floors.shape)


def walk(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties) and squared distance of each row; both arrays are of one integer type."""
    rows, dims = values.shape
    k = len(centroids)
    lists = np.argsort(centroids, axis=0, kind="stable")  # (k, dims): numbers of the centroids by value
    sorted_ = np.take_along_axis(centroids, lists, axis=0)
    right = np.stack([np.searchsorted(sorted_[:, d], values[:, d], "left") for d in range(dims)], axis=1)
    left = right - 1
    best, number = np.zeros(rows, values.dtype), np.full(rows, -1)
    seen = np.zeros((rows, k), bool)
    active, every = np.arange(rows), np.arange(dims)
    for _ in range(k):
        x, low, high = values[active], left[active], right[active]
        below = np.where(low >= 0, x - sorted_[np.maximum(low, 0), every], -1)
        above = np.where(high < k, sorted_[np.minimum(high, k - 1), every] - x, -1)
        down = (above < 0) | ((below >= 0) & (below <= above))
        frontier = np.where(down, below, above)
        met = lists[np.where(down, low, high), every]
        left[active], right[active] = low - down, high + ~down
        new = np.zeros((len(active), k), bool)
        new[np.arange(len(active))[:, None], met] = True
        new &= ~seen[active]
        seen[active] |= new
        for c in range(k):
            at = active[new[:, c]]
            if len(at):
                apart = values[at] - centroids[c]
                exact = (apart * apart).sum(axis=1)
                nearer = (number[at] < 0) | (exact < best[at]) | ((exact == best[at]) & (c < number[at]))
                best[at[nearer]], number[at[nearer]] = exact[nearer], c
        active = active[((frontier * frontier).sum(axis=1) <= best[active]).astype(bool)]
        if not len(active):
            break
    return number, best


def nearest(values: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Nearest centroid and exact squared distance of each row, of integers of any size.

    Rows and centroids whose distances surely fit a long are walked in machine integers, the others in Python's.  A centroid with a component beyond
    2**33 is farther from such a row than any centroid of such size.
    """
    dims = values.shape[1]
    bound = int((2.0**62 / max(dims, 1)) ** 0.5 / 2)
    largest = np.array([max(map(abs, map(int, c)), default=0) for c in centroids], dtype=object)
    small_rows = np.array((np.abs(values).max(axis=1, initial=0) <= bound), bool)
    near, far = np.flatnonzero(largest <= bound), np.flatnonzero((largest > bound) & (largest <= 1 << 33))
    number, distance = np.full(len(values), -1), [0] * len(values)
    exact_rows = np.flatnonzero(~small_rows) if len(near) and not len(far) else np.arange(len(values))
    fast_rows = np.flatnonzero(small_rows) if len(near) and not len(far) else np.array([], int)
    for at, some, kind in ((fast_rows, near, np.int64), (exact_rows, np.arange(len(centroids)), object)):
        centres = centroids[some].astype(kind)
        for low in range(0, len(at), BLOCK):
            rows = at[low : low + BLOCK]
            found, apart = walk(values[rows].astype(kind), centres)
            number[rows] = some[found]
            for row, d in zip(rows.tolist(), apart.tolist()):
                distance[row] = d
    return number, distance


def limbs(value: int) -> list[tuple[int, int]]:
    """(limb, digit) that add up to the value in base 2**LIMB; an ordinary integer is one digit."""
    out = []
    while not -(1 << 62) < value < 1 << 62:
        out.append((len(out), value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return [*out, (len(out), value)]


def usable(vector: Column, dimensions: int) -> Column:
    """Exactly so many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """float64 (rows, dimensions) of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


def first_centroids(rows: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:id, ties by the vector; those without id come last."""
    hash_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    chosen = rows.select(hash_.alias("hash"), "vector").orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).collect()
    return np.stack([quantise(np.array([r["vector"]], float), scale)[0].astype(object) for r in chosen]) if chosen else np.zeros((0, 0), object)


def next_centroids(rows: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """Floored means of the vectors nearest to each centroid; a centroid without any stays."""
    k, dims = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), object), [0] * k
        for batch in batches:
            values = quantise(matrix(batch.column(0), dims), scale)
            number, _ = nearest(values, centroids)
            for c in np.unique(number).tolist():
                mine = values[number == c]
                safe = int(np.abs(mine).max()) < (1 << 62) // len(mine)
                sums[c] += np.array([int(x) for x in (mine if safe else mine.astype(object)).sum(axis=0)], object)
                counts[c] += len(mine)
        out = [(c, d, n, digit) for c in range(k) if counts[c] for d in range(dims) for n, digit in limbs(int(sums[c, d]))]
        out += [(c, -1, 0, counts[c]) for c in range(k) if counts[c]]
        columns = list(zip(*out)) or [()] * 4
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=["cluster", "dimension", "limb", "digit"])

    parts = rows.select("vector").mapInArrow(add, "cluster int, dimension int, limb int, digit long")
    total = parts.groupBy("cluster", "dimension", "limb").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    sums, counts, out = {}, {}, centroids.copy()
    for r in total.collect():  # bounded: clusters x dimensions x limbs
        if r["dimension"] < 0:
            counts[r["cluster"]] = int(r["digit"])
        else:
            at = r["cluster"], r["dimension"]
            sums[at] = sums.get(at, 0) + (int(r["digit"]) << (LIMB * r["limb"]))
    for (c, d), value in sums.items():
        out[c, d] = value // counts[c]
    return out


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Part take those with exactly ``dimensions`` components, none null or non-finite; each component becomes floor(scale * x).  The first
    centroids are the k vectors with the smallest sha256 of ``seed:key`` (fewer vectors: all; a null key comes last and equal
    keys are ordered by their vector).  Repeated rows count each.  Means are floored; ties of the distance go to the smaller number.  Integers are exact at any size;
    a distance or an inertia beyond a long is null.  No vectors give no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(vector), dimensions)).select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    centroids = first_centroids(rows, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = next_centroids(rows, centroids, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, apart = nearest(quantise(matrix(batch.column(1), dimensions), scale), centroids)
            distances = pa.array([d if d <= LARGEST else None for d in apart], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), distances], names=["id", "cluster", "distance"])

    schema = StructType([rows.schema["id"], StructField("cluster", IntegerType()), StructField("distance", LongType())])
    placed = stored(rows.mapInArrow(assign, schema) if len(centroids) else spark.createDataFrame([], schema))
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(total.alias("total")).collect()}  # at most k rows
    whole = sum(sums.values()) if None not in sums.values() else None
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]

    def fits(value) -> int | None:
        return int(value) if value is not None and value <= LARGEST else None

    known = [(c, fits(sums.get(c)), fits(whole), digest) for c, digest in enumerate(digests)]
    named = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = placed.join(F.broadcast(named), "cluster")  # at most k rows
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
