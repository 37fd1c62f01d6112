"""Quality classifier: its parts against plain loops, odd tables, held-out accuracy."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteweave.llm import quality
from noteweave.llm.queries import LLM_QUERIES
from noteweave.llm.quality import BUCKETS, DIMENSIONS, Network, Pooling, Words, context_vectors, index_vectors, score, train

GOOD = ["the cat sat on a mat and saw the dog run by", "a man and the boy went by the old house on a hill", "she saw the sea and the sky in the old town"]
BAD = ["buy### now### cheap### pills### win### big###", "win### cash### now### click### here### win###", "cheap### click### buy### big### pills### now###"]


def test_contexts_equal_plain_loops(spark, monkeypatch):
    texts = GOOD + BAD + [None, "", "one", "a b\nc\x0bd", "r " * 700]
    monkeypatch.setattr(quality, "CHUNK", 50)
    places, signs = index_vectors()
    want, n = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    for text in texts:
        ids = [zlib.crc32(w) % BUCKETS for w in (text or "").encode().split()]
        for i, a in enumerate(ids):
            n[a] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    want[a, places[ids[j]]] += signs[ids[j]]
    got, counts = context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert (got == want).all() and (counts == n).all()
    words = Words()
    chunked, pooling = [], Pooling.of(got, counts)
    for size in (7, 10**6):
        monkeypatch.setattr(quality, "CHUNK", size)
        chunked.append(np.stack([pooling.pool(words.of((t or "").encode())) for t in texts]))
    assert np.allclose(*chunked, atol=1e-4)


def test_words_are_remembered_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(Words, "MOST", 3)
    words = Words()
    ids = words.of(b" a b\tc\x0bd a\x1cb ")
    assert ids.tolist() == [zlib.crc32(w) % BUCKETS for w in (b"a", b"b", b"c", b"d", b"a\x1cb")] and len(words) <= 3


def test_temperature_is_of_rows_that_the_weights_do_not_see():
    drawn = np.random.default_rng(0)
    x = drawn.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))
    y = (drawn.random(4000) < p).astype(float)
    net = Network.fit(x, y)
    held = np.arange(4000) % 4 == 0

    def loss(t):
        z = net.logits(x[held]) / t
        return np.logaddexp(0, np.where(y[held] == 1, -z, z)).mean()

    assert net.temperature in quality.TEMPERATURES and all(loss(net.temperature) <= loss(t) + 1e-12 for t in quality.TEMPERATURES)
    fresh = drawn.normal(size=(20000, 6))
    truth = 1 / (1 + np.exp(-2 * fresh[:, 0] - fresh[:, 1]))
    assert np.abs(net.scores(fresh) - truth).mean() < 0.06


SCHEMA = "doc_id long, text string, score string, `text read` int, vector int, hash int, quality int"


def scored(spark, docs, labels, **more):
    table = spark.createDataFrame([(*d, "old", 1, 2, 3, 0) for d in docs], SCHEMA)
    judged = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, text string")
    out = score(table, train(table, judged, F.lit(True), **more))
    assert set(out.columns) == set(table.columns)
    return [(r["doc_id"], r["score"]) for r in out.collect()]


def test_odd_rows(spark):
    docs = [(n, (GOOD if n % 2 else BAD)[n % 3]) for n in range(300)]
    odd = [(500, None), (501, ""), (502, " \n"), (503, "x" * 200_000), (None, GOOD[0]), (None, None), (1, BAD[0]), (1, GOOD[1]), (1, GOOD[1])]
    labels = [(n, n % 2) for n in range(2, 200)] + [(3, 1), (4, 1), (6, None), (500, 0), (None, 1), (999, 1), (8, 7)]
    got = scored(spark, docs + odd, labels)
    assert len(got) == 309 and all(0 <= s <= 1 for _, s in got)
    known = dict(got[:300])
    assert min(known[n] for n in range(201, 300, 2)) > 0.7 > 0.3 > max(known[n] for n in range(200, 300, 2))
    assert len({s for d, s in got if d in (501, 502)}) == 1


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(0, 1), (1, 1)], 0.75)])
def test_without_labels_of_both_kinds(spark, labels, want):
    got = scored(spark, [(0, "a b"), (1, "c d"), (2, None)], labels)
    assert [s for _, s in got] == pytest.approx([want] * 3)
    assert scored(spark, [], labels) == []


def test_scores_do_not_depend_on_the_partitions(spark):
    docs = [(n, (GOOD if n % 2 else BAD)[n % 3] + f" w{n}") for n in range(200)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)], "doc_id long, quality int")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    some, others = ({r["doc_id"]: r["score"] for r in score(t, train(t, labels, F.lit(True))).collect()} for t in (table.coalesce(1), table.repartition(7)))
    assert some == pytest.approx(others)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="test tables not present")
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = LLM_QUERIES["op13_quality"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
