"""Mixing, language identification, registered queries and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from noteweave.llm.langid import Filters, fit, grams, identify
from noteweave.llm.mixing import Weights, leaf_budgets, mix
from noteweave.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.compare import difference
from tests.llm import plain

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not present")

# -- mixing --------------------------------------------------------------------------------------


@pytest.mark.parametrize("budget", [0, 10, 100, 777, 5000, 10**6])
def test_budgets_equal_plain_water_filling(spark, budget):
    weights = Weights(domain={"a": 5, "b": 1}, lang={"x": 3}, source={"s": 2, "t": 1}, other=1)
    leaves = [("a", "x", "s", 10), ("a", "x", "t", 400), ("a", "y", "s", 50), ("b", "x", "s", 900), ("b", "y", "u", 3), ("c", "z", "s", 70)]
    table = spark.createDataFrame(leaves, "m_domain string, m_lang string, m_source string, tokens long")
    got = {tuple(r)[:3]: r["got"] for r in leaf_budgets(table, F.lit(budget).cast("long"), weights, 2).collect()}
    want = {}
    room = defaultdict(int)
    for d, l, s, n in leaves:
        room[d] += 2 * n
        room[d, l] += 2 * n
    domains = plain.water_filling(budget, {d: (weights.domain.get(d, 1), room[d]) for d in {x[0] for x in leaves}})
    for d, b in domains.items():
        langs = plain.water_filling(b, {l: (weights.lang.get(l, 1), room[d, l]) for e, l, *_ in leaves if e == d})
        for l, c in langs.items():
            for s, n in plain.water_filling(c, {s: (weights.source.get(s, 1), 2 * n) for e, m, s, n in leaves if (e, m) == (d, l)}).items():
                want[d, l, s] = n
    assert got == want


def mixed(spark, rows, **more):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch string, taken int")
    options = {"domain": "CASE WHEN source = 's' THEN 'one' ELSE 'two' END", "share": 0.6, "weights": Weights(), "tokens": "length(text)", **more}
    return mix(table, **options)


def test_prefixes_end_at_the_token(spark):
    rnd = random.Random(5)
    rows = [(n, "x" * rnd.randint(0, 60), rnd.choice(["en", "de", None]), rnd.choice(["s", "t", None]), "e", 1) for n in range(600)]
    total = sum(len(r[1]) for r in rows)
    got = mixed(spark, rows).collect()
    assert abs(sum(r["taken"] for r in got) - int(total * 0.6)) <= 9  # a floor per leaf and level
    partial = [r for r in got if r["taken"] < r["n_tokens"]]
    assert len({(r["domain"], r["lang"], r["source"]) for r in partial}) == len(partial)
    assert all(0 < r["taken"] <= r["n_tokens"] == len(r["text"]) for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed(spark, rows[::-1]).collect()), key=repr)
    assert sorted(map(tuple, got), key=repr) != sorted(map(tuple, mixed(spark, rows, seed=8).collect()), key=repr)


def test_epochs_repeat_scarce_leaves(spark):
    rows = [(n, "x" * 10, "en", "s" if n < 10 else "t", "e", 1) for n in range(110)]
    got = mixed(spark, rows, share=0.5, max_epochs=3).collect()
    scarce = [r for r in got if r["domain"] == "one"]
    assert sum(r["taken"] for r in scarce) == 275 and {r["epoch"] for r in scarce} == {1, 2, 3}
    assert sum(r["taken"] for r in got) == 550
    everything = mixed(spark, rows, share=9.0, max_epochs=2).collect()
    assert len(everything) == 220 and all(r["taken"] == r["n_tokens"] for r in everything)


def test_mixing_odd_rows(spark):
    rows = [(1, None, "en", "s", "e", 1), (2, "", "en", "s", "e", 1), (None, "abcd", None, None, "e", 1), (3, "abc", "en", "s", None, None), (3, "abc", "en", "s", None, None)]
    got = mixed(spark, rows, share=1.0, max_epochs=1).collect()
    assert sorted(((r["doc_id"], r["taken"]) for r in got), key=repr) == [(3, 3), (3, 3), (None, 4)]
    assert mixed(spark, rows, share=1.0, max_epochs=1, weights=Weights(source={"s": 0}, other=1)).count() == 1
    assert mixed(spark, []).collect() == []


@pytest.mark.parametrize("share", [0.1, 0.25, 0.5, 0.77])
def test_repeated_rows_end_a_prefix_at_the_token(spark, share):
    rows = [(7, "x" * 10, "en", "s", f"e{n}", n) for n in range(700)] + [(n, "x" * (n % 9 + 1), "en", "t" if n % 2 else "s", "e", 1) for n in range(100, 300)]
    total = sum(len(r[1]) for r in rows)
    got = mixed(spark, rows, share=share, max_epochs=1).collect()
    assert abs(sum(r["taken"] for r in got) - int(total * share)) <= 6  # a floor per leaf and level
    partial = [r for r in got if r["taken"] < r["n_tokens"]]
    assert len({(r["domain"], r["lang"], r["source"]) for r in partial}) == len(partial) and all(r["taken"] > 0 for r in got)


def test_mixing_columns_of_any_name(spark):
    names = ["need", "epochs", "rest", "cut", "cut_tokens", "m_key", "m_domain", "m_lang", "m_source", "m_tokens", "m_place", "m_partial", "m_epoch", "m_row", "bin0", "bin1", "place", "weight", "room", "got", "tokens"]
    rows = [(n, "x" * (n % 7 + 1), "en", "s" if n % 3 else "t") for n in range(50)]
    plainly = mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), domain="'d'", share=0.5, weights=Weights(), tokens="length(text)")
    wide = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], ["doc_id", "text", "lang", "source", *names])
    got = mix(wide, domain="'d'", share=0.5, weights=Weights(), tokens="length(text)")
    assert sorted(map(tuple, got.select(*plainly.columns).collect())) == sorted(map(tuple, plainly.collect()))
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names)


# -- languages -----------------------------------------------------------------------------------


def test_grams_do_not_cross_texts():
    key, owner, letters = grams(["ab", "", "1 2", "ÀB"])
    assert letters.tolist() == [2, 0, 0, 2] and owner.tolist() == [0, 0, 3, 3]
    assert len(set(key.tolist())) == 3  # both end in "b"
    assert grams(["ÀB"])[0].tolist() == grams(["àb"])[0].tolist()


def test_odd_texts_are_und(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "123 !?", "de"), (6, "der und die", None)]
    table = spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    filters = fit(table, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(table, filters).collect()}
    assert {d: p for d, (p, _) in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "de"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[3][1] == 0
    assert identify(table.limit(0), filters).collect() == []
    nothing = fit(table.where("false"), F.lit(True))
    assert nothing.languages == [] and {r["lang_pred"] for r in identify(table, nothing).collect()} == {"und"}


def test_more_than_64_languages():
    import numpy as np

    names = [f"l{n:03}" for n in range(70)]
    masks = np.zeros((2, 1 << 12), np.uint64)
    from noteweave.llm.langid import slot

    for n, text in enumerate(f"{chr(0x100 + 2 * n) * 6}" for n in range(70)):
        for probe in (0, 1):
            masks[n >> 6, slot(grams([text])[0], probe, 12)] |= np.uint64(1) << np.uint64(n & 63)
    judged, _ = Filters(names, masks, 12).judge([chr(0x100 + 2 * n) * 6 for n in range(70)])
    assert judged == names


@needs_tables
def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in LLM_QUERIES["op7_language_id"](spark, folder).collect() if r["held_out"]]
    assert len(rows) > 150 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.97


# -- registered queries ----------------------------------------------------------------------------


@needs_tables
@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark, FOLDER, name) is None


@needs_tables
def test_queries_without_sql_equal_plain_versions(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in LLM_QUERIES["op10_token_counts"](spark, FOLDER).collect()}
    assert got == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 1024) for d, t in docs.items()}
    pieces = LLM_QUERIES["op1_pack_binary"](spark, FOLDER).collect()
    import struct

    for r in pieces:
        some = (ids[r["doc_id"]] + [1])[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(some)}I", *some)) and r["doc_tokens"] == len(ids[r["doc_id"]]) + 1
    assert sum(r["length"] for r in pieces) == sum(len(x) + 1 for x in ids.values())
    prints = {d: plain.simhash(t) for d, t in docs.items()}
    values = sorted(set(prints.values()))
    roots = plain.components(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4])
    least = {}
    for d, p in prints.items():
        least[roots[p]] = min(d, least.get(roots[p], d))
    rows = LLM_QUERIES["op4_simhash_near_dedup"](spark, FOLDER).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {d: (f"{p:016x}", least[roots[p]]) for d, p in prints.items()}
    order = sorted(docs)
    for r in LLM_QUERIES["op8_threshold_sketch"](spark, FOLDER).collect():
        text, after = docs[r["doc_id"]], docs[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        k = len(text) // 4
        a, b, c = (set(plain.sketch(t, 5, 2)) for t in (text, text[: len(text) - k] + after[:k], after))
        assert r["near_edited"] == pytest.approx(plain.jaccard(a, b)) and r["near_next"] == pytest.approx(plain.jaccard(a, c))
        assert r["fingerprint"] == "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(a))


# -- pipeline --------------------------------------------------------------------------------------


@needs_tables
def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    tables = {"documents": {r["doc_id"]: r for r in docs.collect()}}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if n < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            tables[name] = {r["doc_id"]: r for r in docs.collect()}
            assert docs.count() == len(tables[name])
    first = {d: r["text"] for d, r in tables["documents"].items()}
    known, lines, near, kept = (tables[n] for n, _ in corpus_pipeline.STAGES[:4])
    assert len(known) >= 0.97 * len(first) and all(known[d]["text"] == first[d] for d in known)
    for d, r in lines.items():  # lines only go, and only such as stand in another document
        before = known[d]["text"].split("\n")
        assert not set(r["text"].split("\n")) - set(before)
    groups = plain.near_groups({d: r["text"] for d, r in lines.items()})
    assert set(near) == {d for d, g in groups.items() if d == g}
    assert set(kept) <= set(near) and all(kept[d]["text"] == near[d]["text"] for d in kept)
    whole = defaultdict(list)
    for r in docs.collect():
        whole[r["doc_id"]].append(r)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(whole) == set(kept)
    for d, pieces in whole.items():
        ids = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"]))
        want = library.encode(kept[d]["text"], add_special_tokens=False).ids + [1]
        assert memoryview(ids).cast("I").tolist() == want


@needs_tables
def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 200 and "sequence_id" in rows.columns


ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat and the dog " * 9, "en", "src0", 3), (3, "the cat and the dog " * 9, "en", "src1", 3), (4, "der Hund und die Katze " * 9, "de", None, 3), (3, "the cat and the dog " * 9, "en", "src1", 3), (5, "x" * 20_000, "en", "src2", 1)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines int, domain string, p0 string, length int"
    docs = spark.createDataFrame([(*r, "a", 1, "b", "c", 2) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        count = out.count()
        assert count == 0 if not rows else count > 0
        if name == "simhash_near_dedup" and rows:
            ids = [r["doc_id"] for r in out.collect()]
            assert ids.count(3) == 1 and ids.count(None) == 0  # a copy of 3


def test_unlabelled_documents_with_letters_stay(spark):
    rows = [(1, "the cat", None, "s", 7), (2, None, None, "s", 0), (3, "123 !?", None, "s", 6), (4, "日本", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()) == [1, 4]
