"""Token ids, token counts, packing and binary output against the tokenizer library."""

import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteweave.llm.binary import materialise, permute_once, read_layout, read_slots, with_index, with_slot
from noteweave.llm.packing import binary_lengths, pack, write_buckets
from noteweave.llm.queries import LLM_QUERIES
from noteweave.llm.tokencount import Transducer, count_tokens
from noteweave.llm.tokens import TokenIds
from noteweave.llm.storage import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE, IDS = Transducer(PATH), TokenIds(PATH)

parts = ["a", "es", "The", "ing", "re", " ", "  ", "\n", "\t", "\r\n", "1", "2024", "'", "'s", "'re", "'l", "'ll", "é", "ß", "日本", "—", "😀", "!", "..", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u200b", "½", "<|endoftext|>", "<|endo"]
texts = st.one_of(st.lists(st.sampled_from(parts), max_size=25).map("".join), st.text(max_size=40))


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.sampled_from([1, 2, 5, 256]))
def test_transducer_counts_like_the_library(some, chunk):
    some = [t.encode("utf-8", "replace").decode() for t in some]
    assert MACHINE.counts(some, chunk).tolist() == [len(library_ids(t)) for t in some]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_those_of_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == library_ids(text)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 9_999 + "x", "\n" * 1001 + "y", "'" * 999, "é" * 5000, "x " * 20_000])
def test_long_runs(text):
    assert MACHINE.counts([text]).tolist() == [len(library_ids(text))]
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == library_ids(text)


def test_full_tables_are_compiled_anew(monkeypatch):
    monkeypatch.setattr("noteweave.llm.tokencount.MOST_STATES", 10)
    machine = Transducer(PATH)
    for text in ("The first text.", "another one, with 42 words", "The first text."):
        assert machine.counts([text]).tolist() == [len(library_ids(text))]


CASES = [(1, "The end."), (2, None), (3, ""), (None, "no id"), (4, "x" * 5000 + " tail"), (1, "The end."), (5, "a <|endoftext|> b"), (6, "word " * 3000)]


def table(spark, rows=CASES):
    return spark.createDataFrame([(d, t, 7, "s") for d, t in rows], "doc_id long, text string, length long, n_tokens string")


def test_counts_of_a_table(spark):
    got = sorted(map(tuple, count_tokens(table(spark), PATH).collect()), key=repr)
    assert got == sorted(((d, len((t or "").encode()), len(library_ids(t or ""))) for d, t in CASES), key=repr)
    assert count_tokens(table(spark, []), PATH).collect() == []


def test_binary_lengths():
    assert binary_lengths(13, 8) == [8, 4, 1] and binary_lengths(16, 8) == [8, 8] and binary_lengths(0, 8) == []


def test_pieces_put_together_are_the_documents(spark, tmp_path):
    pieces = pack(table(spark), PATH, longest=64, end_id=1)
    rows = pieces.collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    docs = {}
    for r in rows:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["bucket"] == r["length"].bit_length() - 1
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    for d, t in CASES:
        whole = library_ids(t or "") + [1]
        found = sorted(docs[(d, len(whole))])
        copies = CASES.count((d, t))
        starts = [s for s, _ in found][::copies]
        assert [x for s, ids in found[::copies] for x in ids] == whole
        assert starts == np.cumsum([0, *(len(ids) for _, ids in found[::copies])])[:-1].tolist()
    write_buckets(pieces, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(rows)
    assert pack(table(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        pack(table(spark), PATH, longest=100)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000])
def test_slots_are_a_permutation(spark, n):
    slots = [r[0] for r in with_slot(spark.range(n).withColumnRenamed("id", "i"), "i", "slot", n, 5).select("slot").collect()]
    assert sorted(slots) == list(range(n))
    if n == 1000:
        other = [r[0] for r in with_slot(spark.range(n).withColumnRenamed("id", "i"), "i", "slot", n, 6).select("slot").collect()]
        assert slots != list(range(n)) and slots != other


def test_network_is_a_permutation_of_its_domain(spark):
    from pyspark.sql import functions as F

    for n in (5, 30, 100, 1000):
        size = 1 << max(2, (n - 1).bit_length())
        values = [r[0] for r in spark.range(size).select(permute_once(F.col("id"), n, 3)).collect()]
        assert sorted(values) == list(range(size))


@pytest.mark.parametrize("ids, per_shard, flush", [(16, 3, 500_000), (16, 3, 40), (64, 1000, 1), (1, 50, 100)])
def test_shards_hold_every_id_once(spark, monkeypatch, ids, per_shard, flush):
    monkeypatch.setattr("noteweave.llm.binary.FLUSH_IDS", flush)
    docs = table(spark, [r for r in CASES if r[0] != 6]).coalesce(1)
    folder = new_folder(spark, "shards")
    layout = materialise(docs, PATH, folder, ids=ids, per_shard=per_shard, seed=3)
    assert read_layout(spark, folder) == layout
    stream = [x for _, t in [tuple(r)[:2] for r in docs.collect()] for x in library_ids(t or "") + [50256]]
    assert layout.sequences == -(-len(stream) // ids)
    padded = stream + [50256] * (-len(stream) % ids)
    want = sorted(struct.pack(f"<{ids}H", *padded[at : at + ids]) for at in range(0, len(padded), ids))
    rows = read_slots(spark, folder, layout).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(layout.sequences))
    assert sorted(bytes(r["record"]) for r in rows) == want
    assert all(r["offset"] == (r["slot"] % per_shard) * layout.stride and r["shard"] == r["slot"] // per_shard for r in rows)
    # Sequential and resumed reads agree; the index tells where a record comes from.
    middle = layout.sequences // 2
    assert [r["slot"] for r in read_slots(spark, folder, layout, middle).orderBy("slot").collect()] == list(range(middle, layout.sequences))
    index = {r["slot"]: r for r in spark.read.parquet(f"{folder}/index").collect()}
    assert sum(r["n_ids"] for r in index.values()) == len(stream) and len(index) == layout.sequences
    by_crc = {zlib.crc32(bytes(r["record"])): r["slot"] for r in rows}
    whole = {d: library_ids(t or "") + [50256] for d, t in CASES}
    for at in range(0, len(padded), ids):
        found = index[by_crc[zlib.crc32(struct.pack(f"<{ids}H", *padded[at : at + ids]))]]
        if ids == 16:
            assert whole[found["doc_id"]][found["start"]] == padded[at]


def test_no_documents_give_no_records(spark):
    folder = new_folder(spark, "shards")
    layout = materialise(table(spark, []), PATH, folder, ids=8)
    assert layout.sequences == 0 and spark.read.parquet(f"{folder}/index").count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
def test_query_gives_the_ids_of_the_library_slot_by_slot(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    stream, place = [], {}
    for d, t in docs:
        place[d] = len(stream)
        stream += library_ids(t or "") + [50256]
    rows = LLM_QUERIES["op6_training_order"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["slot"] for r in rows) == list(range(-(-len(stream) // 2048))) and sum(r["n_ids"] for r in rows) == len(stream)
    for r in rows:
        some = stream[place[r["doc_id"]] + r["start"] :][: r["n_ids"]]
        assert len(some) == r["n_ids"] and r["ids_crc32"] == zlib.crc32(struct.pack("<2048H", *some, *[50256] * (2048 - len(some))))
        assert r["shard"] == r["slot"] // 4096 and r["offset"] == r["slot"] % 4096 * 4097


def test_index_is_dense_over_partitions(spark, monkeypatch):
    monkeypatch.setattr("noteweave.llm.binary.BLOCK", 3)
    rows = [(p, n) for p in (0, 2, 3, 4, 7, 11, 12) for n in range(p % 3 + 1)]
    for most in (1_000_000, 0):
        monkeypatch.setattr("noteweave.llm.binary.MOST_PARTITIONS", most)
        got = with_index(spark.createDataFrame(rows, "partition int, number long")).collect()
        assert sorted((r["index"], r["partition"], r["number"]) for r in got) == [(n, *r) for n, r in enumerate(rows)]
