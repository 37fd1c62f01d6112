"""Centroid clustering against plain integer loops."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from noteweave.llm.centroids import cluster, limbs, nearest, walk

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance double, hash int, vector string, id int"


def plain_clusters(rows, k, rounds, dims, scale, seed=3):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    def order(r):
        return (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])

    centres = [v for _, v in sorted(kept, key=order)[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    out = [(i, *place(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in out:
        inertia[n] = inertia.get(n, 0) + d
    long = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, long(d), long(inertia[n]), long(sum(inertia.values())), digest[n]) for i, n, d in out), key=repr)


def clustered(spark, rows, **options):
    table = spark.createDataFrame([(*r, "a", 0.5, 1, "b", 2) for r in rows], SCHEMA)
    return sorted(map(tuple, cluster(table, **options).collect()), key=repr)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_walk_equals_all_distances(kind):
    rnd = np.random.default_rng(1)
    for k, dims, spread in ((1, 3, 5), (8, 64, 300), (5, 2, 2), (30, 1, 4), (40, 6, 3)):
        values = rnd.integers(-spread, spread, (200, dims))
        centres = rnd.integers(-spread, spread, (k, dims))
        every = ((values[:, None] - centres) ** 2).sum(axis=2)
        number, best = walk(values.astype(kind), centres.astype(kind))
        assert number.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()


def test_walk_stops_before_all_centroids_are_met():
    met = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, int):
                met.append(at)
            return super().__getitem__(at)

    centres = (np.arange(50)[:, None] * np.array([100, 100])).view(Watched)
    assert walk(np.array([[1, 2], [401, 398]]), centres)[0].tolist() == [0, 4]
    assert len(set(met)) < 10


def test_numbers_of_any_size():
    values = np.array([[10**30, 5], [3, 4], [-(10**30), 0], [2**40, 1]], dtype=object)
    centres = np.array([[10**30, 0], [0, 0], [2**35, 7]], dtype=object)
    number, distance = nearest(values, centres)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres.tolist())) for v in values.tolist()]
    assert list(zip(distance, number.tolist())) == want
    for value in (0, -1, 2**62, -(2**62), 10**40, -(10**40) - 7):
        assert sum(digit << (40 * n) for n, digit in limbs(value)) == value
        assert all(abs(digit) < 1 << 62 for _, digit in limbs(value))


@pytest.mark.parametrize("dims, k, rounds", [(64, 8, 10), (3, 4, 10), (2, 8, 3)])
def test_clusters_equal_plain_loops(spark, dims, k, rounds):
    rnd = random.Random(dims)
    rows = [(n, [rnd.gauss(n % 5, 0.3) for _ in range(dims)]) for n in range(300)]
    rows += [(300 + n, [0.5] * dims) for n in range(60)]  # one very common vector
    rows += [(400, None), (401, []), (402, [1.0] * (dims - 1)), (403, [float("nan")] * dims), (404, [float("inf")] + [0.0] * (dims - 1)), (405, [None] * dims)]
    rows += [(None, [0.25] * dims), rows[3], rows[3], (7, [9.0] * dims)]
    options = {"k": k, "rounds": rounds, "dimensions": dims, "scale": 1024}
    assert clustered(spark, rows, **options) == plain_clusters(rows, k, rounds, dims, 1024)


def test_large_components_and_few_vectors(spark):
    rows = [(n, [float(n), 2.0]) for n in range(40)] + [(50, [1e30, -3e38]), (51, [-1e6, 1e6]), (52, [3e9, 1.0])]
    options = {"k": 8, "rounds": 4, "dimensions": 2, "scale": 1024}
    assert clustered(spark, rows, **options) == plain_clusters(rows, 8, 4, 2, 1024)
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert clustered(spark, few, **options) == plain_clusters(few, 8, 4, 2, 1024)
    assert clustered(spark, [], **options) == [] and clustered(spark, [(1, None)], **options) == []
