"""Top-k, SimHash, line dedup, sketches and URL rules against plain versions."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteweave.llm import simhash, topk
from noteweave.llm.components import connected
from noteweave.llm.linedup import align, common_blocks, dedup_lines
from noteweave.llm.simhash import link_fingerprints, near_duplicates, similar_documents
from noteweave.llm.sketch import fingerprint_text, fingerprints_with_edits, merged, resemblance, with_sketch
from noteweave.llm.urlrules import Rule, judge, place_rule
from tests.llm import plain

# -- top-k ---------------------------------------------------------------------------------------


def searched(spark, rows, k=5):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    return sorted(map(tuple, topk.top_k(table, k, F.col("vec_id") % 50 == 0).collect()))


def quantise(rows):
    return [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v in rows]


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rnd = random.Random(1)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(7)]) for i in range(300)]
    rows += [(i + 300, rows[3][1]) for i in range(70)]  # ties across block borders
    assert searched(spark, rows) == plain.top_k(quantise(rows), 5)


def test_top_k_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (50, [-1.0, 0.5]), (3, [1.0, 2.0])]
    odd = [(100, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (150, [None, 1.0]), (None, [1.0, 1.0])]
    assert searched(spark, good + odd) == plain.top_k(quantise(good), 5)
    assert searched(spark, [(0, [1.0])]) == [] and searched(spark, []) == []
    assert searched(spark, good + [(7, [])])[:2] == [(0, 1, 3, 327680), (0, 2, 1, 0)]
    repeated = searched(spark, good + [(0, [1.0, 2.0]), (3, [1.0, 2.0])])
    assert [r for r in repeated if r[0] == 0][:2] == [(0, 1, 3, 327680), (0, 2, 3, 327680)]


def test_top_k_of_large_components(spark):
    rnd = random.Random(8)
    rows = [(n, [rnd.uniform(-2, 2) for _ in range(3)]) for n in range(60)]
    rows += [(100, [1e6, -1.0, 2.0]), (101, [1e30, 1.0, 0.0]), (102, [-1e30, 1.0, 3e38]), (150, [3e38, 3e38, -3e38]), (103, [1e30, 1.0, 0.0]), (104, [4e7, 0.0, 0.0])]
    exact = [(i, [int(x) for x in np.floor(256 * np.array(v, np.float32).astype(float))]) for i, v in rows]
    want = [(q, r, i, s if -(1 << 63) < s < 1 << 63 else None) for q, r, i, s in plain.top_k(exact, 5)]
    assert searched(spark, rows) == want


# -- components and SimHash ------------------------------------------------------------------------


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(9, i) for i in range(20)], [(1, 1)], []])
def test_components(spark, links):
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links for n in (a, b) if a != b}
    assert got == plain.components(sorted(nodes), [x for x in links if x[0] != x[1]])


def near_texts():
    rnd = random.Random(2)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for d in range(12):
        base = [rnd.choice(words) for _ in range(120)]
        for copy in range(6):
            some = list(base)
            for _ in range(copy // 2):
                some[rnd.randrange(120)] = rnd.choice(words)
            rows.append((d * 10 + copy, " ".join(some).upper() if copy == 1 else " ".join(some)))
    return rows + [(500, None), (501, ""), (502, " \n\t"), (503, "one two"), (504, "ONE  two"), (505, "É é"), (0, rows[0][1]), (None, rows[0][1])]


def near_table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fingerprint string, p0 int")


@pytest.mark.parametrize("block, short", [(4096, 16), (8, 2)])
def test_simhash_classes_equal_brute_force(spark, monkeypatch, block, short):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT", short)
    rows = near_texts()
    prints = {(d, t): plain.simhash(t) for d, t in rows}
    values = sorted(set(prints.values()))
    roots = plain.components(values, [(a, b) for a in values for b in values if a < b and bin(a ^ b).count("1") <= 4])
    least = {}
    for (d, t), p in prints.items():
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    want = sorted(((d, f"{prints[d, t]:016x}", least[roots[prints[d, t]]]) for d, t in rows), key=repr)
    assert sorted(map(tuple, near_duplicates(near_table(spark, rows)).collect()), key=repr) == want
    assert near_duplicates(near_table(spark, [])).collect() == []


def test_links_of_a_dense_cloud_connect_it(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(3)
    values = {0}
    while len(values) < 150:
        values.add(rnd.choice(sorted(values)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = link_fingerprints(spark.createDataFrame([(v, v) for v in signed], "node long, p0 long"), 1, 4).distinct().collect()
    got = plain.components(sorted(signed), [tuple(r) for r in found])
    assert len(set(got.values())) == 1 and all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in found)


def test_similar_documents_find_what_brute_force_finds(spark):
    rows = [r for r in near_texts() if r[0] is not None][:-1]
    want = plain.near_groups(dict(rows))
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(near_table(spark, rows)).collect()}
    assert got == want
    assert similar_documents(near_table(spark, [])).collect() == []
    assert [r["component_id"] for r in similar_documents(near_table(spark, [(None, "a b"), (None, "a b")])).collect()] == [None, None]


def test_similar_documents_find_tails_and_blocks(spark):
    rnd = random.Random(6)
    rows = []
    for pair in range(60):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        new = [f"w{rnd.randrange(10**6)}" for _ in range(46)]
        rows.append((2 * pair, " ".join(base)))
        rows.append((2 * pair + 1, " ".join(base + new if pair % 2 else base[:90] + new[:16] + base[106:])))
    want = plain.near_groups(dict(rows))
    assert len(set(want.values())) == 60
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(near_table(spark, rows)).collect()} == want


@pytest.mark.parametrize("n", [40, 160])
def test_pairs_that_fail_are_not_written(spark, monkeypatch, n):
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(n):
        at = rnd.randrange(50)
        texts.append(base[:at] + [f"x{rnd.randrange(10**6)}" for _ in range(10)] + base[at + 10 :])
    rows = list(enumerate(map(" ".join, texts)))
    made = []

    def counted(links):
        made.append(links.count())
        return links

    left = simhash.links_left
    monkeypatch.setattr(simhash, "links_left", lambda *a: counted(left(*a)))
    want = plain.near_groups(dict(rows))
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(near_table(spark, rows)).collect()} == want
    keys = simhash.index_size(0.8)[0]
    assert made and made[0] <= keys * (n - 1)


def test_joining_links_join_what_similar_pairs_join():
    import numpy as np

    rnd = random.Random(2)
    pool = [sorted(rnd.sample(range(40), 25)) for _ in range(3)]
    sets = [np.array(sorted(set(rnd.choice(pool)) ^ set(rnd.sample(range(40), rnd.randint(0, 4)))), np.int64) for _ in range(90)] + [np.zeros(0, np.int64)] * 2
    prints, start = np.zeros((92, 1), np.uint64), np.arange(92) // 2
    for begin in (0, 30):
        pairs = [(a, b) for a in range(92) for b in range(a + 1, 92) if (not begin or a < begin <= b) and plain.jaccard(set(sets[a].tolist()), set(sets[b].tolist())) >= 0.8]
        inside = [(2 * k, 2 * k + 1) for k in range(46)]
        found = simhash.joining_links(prints, start, sets, 0, 0.8, simhash.bits_between, begin)
        assert plain.components(range(92), found + inside) == plain.components(range(92), pairs + inside)
        assert len(found) < 46 and set(found) <= set(pairs)


@pytest.mark.parametrize("block", [4096, 64])
def test_similar_documents_of_a_dense_group(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "BLOCK_NODES", block // 2)
    rnd = random.Random(7)
    rows = []
    for group in range(3):  # the copies are less alike than 0.8 but for the original and a few
        base = [f"w{rnd.randrange(10**6)}" for _ in range(160)]
        for copy in range(100):
            at, some = rnd.randrange(140), list(base)
            size = 13 if copy else 0
            some[at : at + size] = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            rows.append((group * 1000 + copy, " ".join(some)))
    want = plain.near_groups(dict(rows))
    assert {r["doc_id"]: r["component_id"] for r in similar_documents(near_table(spark, rows)).collect()} == want


# -- line dedup ----------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=14), st.lists(st.sampled_from("abcdefg"), max_size=14))
def test_alignment_is_rising_and_equal(a, b):
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    if a == b:
        assert pairs == [(n, n) for n in range(len(a))]


def deduped(spark, rows, **more):
    table = spark.createDataFrame([(t, d, "x", 3) for d, t in rows], "text string, doc_id long, n_lines string, at int")
    return {(r["doc_id"], n): (r["text"], r["n_lines"], r["n_deleted"], r["at"]) for n, r in enumerate(sorted(dedup_lines(table, **more).collect(), key=repr))}


def test_blocks_of_later_documents_go(spark):
    long = "eight words are in this line of text"
    a, b, c = (f"{x} {long}" for x in "abc")
    rows = [(1, f"start one\n{a}\n{b}\n\nend"), (2, f"other\n{b}\nown line"), (3, f"{a}\n \n{b}\n{c}"), (4, f"{c}\nlast"), (5, "short\nend"), (6, "short\nend")]
    got = {d: (t, gone) for (d, _), (t, _, gone, _) in deduped(spark, rows).items()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("other\nown line", 1)
    assert got[3] == (f" \n{c}", 2) and got[4] == ("last", 1)
    assert got[5][1] == 0 and got[6][1] == 0  # too short a block
    assert {d: gone for (d, _), (_, _, gone, _) in deduped(spark, rows, min_words=2).items()}[6] == 2


def test_a_line_in_many_documents_stays_once(spark):
    line = "this very common line has more than eight words in it"
    rows = [(d, f"own {d}\n{line}\nmore {d}") for d in range(30)]
    got = deduped(spark, rows)
    assert sum(gone for _, _, gone, _ in got.values()) == 29 and [t for (d, _), (t, *_) in got.items() if d == 0] == [rows[0][1]]


def test_line_dedup_of_odd_rows(spark):
    line = "a line that is long enough to be seen as a block"
    rows = [(2, line), (None, line), (1, None), (3, ""), (4, "\n \n"), (5, f"{line}\n{line}"), (2, line), (6, "x\n" * 5000 + line)]
    got = sorted(((d, v[0], v[2], v[3]) for (d, _), v in deduped(spark, rows).items()), key=repr)
    want = [(2, line, 0, 3), (2, line, 0, 3), (None, "", 1, 3), (1, None, 0, 3), (3, "", 0, 3), (4, "\n \n", 0, 3), (6, "x\n" * 4999 + "x", 1, 3)]
    assert [g for g in got if g[0] != 5] == sorted(want, key=repr)
    assert [g[2] for g in got if g[0] == 5] == [1]
    assert deduped(spark, []) == {}


def test_a_frequent_passage_goes_when_its_lines_stood_singly(spark):
    lines = [f"line {n} has just six words" for n in range(10)]
    rows = [(n, f"own {n}\n{line}\nend {n}") for n, line in enumerate(lines)]
    rows += [(100 + n, "\n".join([f"head {n}", *lines, f"tail {n}"])) for n in range(20)]
    got = {d: gone for (d, _), (_, _, gone, _) in deduped(spark, rows).items()}
    assert got == {d: 10 if d > 100 else 0 for d, _ in rows}


def test_repeated_and_crossing_passages_go(spark):
    a, b = (" ".join(f"{name}{n}" for n in range(60)) for name in "ab")
    twice = [(0, f"{a}\nv\n{a}"), (1000, "v\nend")]
    twice += [(n, f"u {n}\n{a}\nw {n}") for n in range(1, 30)] + [(n + 100, f"u {n}\nmore\nw {n}") for n in range(1, 30)]
    got = {d: gone for (d, _), (_, _, gone, _) in deduped(spark, twice).items()}
    assert got == {d: int(0 < d < 30) for d, _ in twice}
    # The later document repeats what stands once before: one copy goes, the other is a repeat inside one document.
    again = [(1, f"r\n{a}\ns"), (2, f"s\n{a}\nq\n{a}\nr"), (3, "q\nend")]
    assert [gone for (_, _, gone, _) in deduped(spark, again).values()].count(1) == 1
    crossed = [(1, f"{a}\nx\n{b}"), (2, f"{b}\ny\n{a}")]
    assert {d: t for (d, _), (t, *_) in deduped(spark, crossed).items()} == {1: crossed[0][1], 2: "y"}


def test_words_are_runs_without_white_space(spark):
    seven, eight = "one two three four five six seven", "one two three four five six seven eight"
    ends = ("", "\r", " \t")
    rows = [(n, f"own {n}{end}\n{lead}{line}{end}\nmore {n}") for line in (seven, eight) for n, (lead, end) in enumerate([(a, b) for a in ("", "\t") for b in ends for _ in (0, 1)], 20 * len(line))]
    got = {d: gone for (d, _), (_, _, gone, _) in deduped(spark, rows).items()}
    assert sum(got[d] for d, _ in rows[:12]) == 0  # seven words, whatever stands around them
    assert [got[d] for d, _ in rows[12:]] == [0, 1] * 6


def test_columns_of_any_name(spark):
    names = ["line key", "deleted at", "k", "at", "later", "earlier", "gone", "hashes", "words", "N_lines_", "text_hash"]
    line = "a line that is long enough to be seen as a block"
    table = spark.createDataFrame([(d, line, *range(len(names))) for d in (1, 2)], ["doc_id", "text", *names])
    got = sorted(map(tuple, dedup_lines(table).collect()))
    assert got == [(1, line, *range(len(names)), 1, 0), (2, "", *range(len(names)), 1, 1)]


@given(st.lists(st.sampled_from("abcdef"), max_size=30), st.lists(st.sampled_from("abcdef"), max_size=30), st.integers(1, 4))
def test_common_blocks_are_common_and_none_is_left(a, b, least):
    ones, text = [1] * 30, "".join(b)
    gone = common_blocks(a, b, ones[: len(a)], ones[: len(b)], least)
    assert len(set(gone)) == len(gone) <= len(b)
    for p in gone:  # inside some run of gone lines that the other document holds
        runs = (range(i, i + least) for i in range(max(0, p - least + 1), p + 1))
        assert any(set(run) <= set(gone) and "".join(a[run.start : run.stop]) in text for run in runs)
    if a == b and len(a) >= least:
        assert gone == list(range(len(a)))
    if not gone:
        assert not any("".join(a[i : i + least]) in text for i in range(len(a) - least + 1))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
def test_line_dedup_equals_a_plain_pairwise_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in dedup_lines(docs).collect()}
    want = plain.line_dedup(texts, 8, common_blocks)
    assert got == {d: (text, n) for d, (text, n) in want.items()} and sum(n for _, n in got.values()) > 50
    # Of a run that stands in an earlier document, no more is left than stands here beyond that (parts of less than eight words aside).
    held: dict[tuple, int] = {}
    for d in sorted(texts):
        lines, kept = plain.text_lines(texts[d]), plain.kept_lines(texts[d], got[d][0])
        here, whole = Counter(), Counter()
        for run, positions in plain.line_runs(lines, 8):
            here[run] += 1
            whole[run] += sum(len(lines[p].split()) for p in positions if kept[p]) >= 8
        assert all(whole[run] <= max(0, n - held.get(run, 0)) for run, n in here.items())
        for run, n in here.items():
            held[run] = max(n, held.get(run, 0))


# -- sketches ------------------------------------------------------------------------------------


def test_sketches_equal_plain_ones(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(n)) for n in (0, 1, 3, 5, 6, 50, 700)] + ["\n x\ty\n", "É ß  日本 z w v"]
    got = with_sketch(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s").collect()
    assert [r["s"] for r in got] == [plain.sketch(t, 5, 2) for t in texts]
    both = spark.createDataFrame([([1, 2, 3],), ([3, 4],)], "s array<long>").agg(merged(F.col("s")).alias("s")).first()
    assert both["s"] == [1, 2, 3, 4]


@pytest.mark.parametrize("bucket_rows", [2, 3000])
def test_edits_follow_the_order(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr("noteweave.llm.sketch.BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr("noteweave.llm.sketch.STRIDE", 3)
    rows = [(n * n, f"text {n} " * (n % 7)) for n in range(40)] + [(1, None), (None, "no id"), (None, "none"), (-5, "日本語のテキスト"), (4, "x")]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    table = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, bucket int")
    got = sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["edited"], r["n_chars"]) for r in fingerprints_with_edits(table).collect()))
    want = []
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 4
        want.append(((d is None, d or 0), t[: len(t) - k] + after[:k], len(t)))
    assert got == sorted(want)


def test_edits_of_few_rows(spark):
    one = fingerprints_with_edits(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefab" and one["n_chars"] == 8
    assert fingerprints_with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only_null = fingerprints_with_edits(spark.createDataFrame([(None, "abcdefgh"), (None, "x")], "doc_id long, text string"))
    assert sorted(r["edited"] for r in only_null.collect()) == ["abcdefx", "x"]
    same = fingerprints_with_edits(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    near = same.select(resemblance(F.col("sketch"), F.col("next_sketch")).alias("r"), fingerprint_text(F.col("sketch")).alias("f")).collect()
    assert [tuple(r) for r in near] == [(1.0, ""), (1.0, "")]
    assert hashlib.sha256(one["edited"].encode()).hexdigest()


# -- URL rules -----------------------------------------------------------------------------------

RULES = [place_rule("allow", "org/"), place_rule("block", "example.org/es/"), place_rule("block", "example.org/en/1"), place_rule("block", "a+b.com/x(y")]


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://WWW.Example.ORG/es/1", ("www.example.org", "/es/1", "example.org/es/", "block")),
        ("https://example.org/en/15?x#y", ("example.org", "/en/15", "example.org/en/1", "block")),
        ("https://example.org/EN/15", ("example.org", "/EN/15", "org/", "allow")),
        ("https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
        ("https://forg/es/", ("forg", "/es/", None, "block")),
        ("https://x.org?q=/", ("x.org", "", None, "block")),
        ("https://a+b.com/x(y)", ("a+b.com", "/x(y)", "a+b.com/x(y", "block")),
        ("example.org/es/", ("", "", None, "block")),
        ("x://y/ads/1", ("y", "/ads/1", None, "allow")),
        (None, ("", "", None, "block")),
        ("", ("", "", None, "block")),
        ("http:///es/", ("", "/es/", None, "block")),
        ("a://b.org/c://d.com/", ("b.org", "/c://d.com/", "org/", "allow")),
    ],
)
def test_url_rules(spark, url, want):
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h"), (None, url, "h")], "page_id long, url string, host string")
    rules = [*RULES, Rule("ads", "allow", "/ads/", ("ads",))]
    rows = judge(pages, rules, otherwise="block").collect()
    assert len(rows) == 3 and {tuple(r)[1:5] for r in rows} == {want}


def test_rules_without_tokens_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c1")], "page_id long, url string")
    assert judge(pages, [Rule("digit", "block", "[0-9]$", ())]).first()["pattern"] == "digit"
    assert judge(pages, [], otherwise="block").first()["verdict"] == "block"
    assert judge(pages.limit(0), RULES).collect() == []
