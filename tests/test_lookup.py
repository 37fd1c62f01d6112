"""Page lookup by narrow keys, membership bitmaps, and element lengths from running sums."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from noteweave.functions.sqltext import SPACES
from noteweave.operators import content, enex, ledger, lookup, order
from noteweave.operators.membership import bloom, might_hold

LONG = "This is a sentence of the article that is long enough to count as content here. " * 2


def test_bitmaps_hold_their_keys(spark):
    keys = spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h"))
    bitmap, bits = bloom(keys, 1000)
    assert bits == 14
    got = {r.id: r.held for r in spark.range(0, 3000).select("id", might_hold(F.xxhash64("id"), bitmap, bits).alias("held")).collect()}
    assert all(got[n] for n in range(0, 3000, 3))
    assert sum(got[n] for n in range(3000) if n % 3) < 80
    empty, bits = bloom(keys.where("false"), 0)
    assert spark.range(50).where(might_hold(F.xxhash64("id"), empty, bits)).count() == 0


def snapshot(spark, path, rows):
    table = spark.createDataFrame(rows, "url string, taken long, content_type string, error string, body binary")
    table.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def page(text):
    return f"<body><article>{text}。{LONG}</article></body>".encode()


def test_latest_copy_wins_and_only_its_body_moves(spark, tmp_path):
    rows = [("u/hot", n, "text/html", None, page(f"copy {n}")) for n in range(400)]
    rows += [("u/a", 2, "text/html", None, page("new")), ("u/a", 1, "text/html", None, page("old")), ("u/a", None, "text/html", None, page("undated"))]
    rows += [("u/pdf", 1, "application/pdf", None, b"%PDF"), ("u/gone", 3, None, "timeout", None), ("u/gone", 1, "text/html", None, page("x"))]
    rows += [("u/none", 1, "text/html", None, None), (None, 1, "text/html", None, page("y")), ("u/other", 1, "text/html", None, page("z"))]
    pages = snapshot(spark, str(tmp_path / "pages"), rows)
    urls = spark.createDataFrame([(u,) for u in ("u/hot", "u/a", "u/pdf", "u/gone", "u/none", "u/missing")], "url string")
    copies = lookup.latest_copies(urls, pages, "taken")
    assert {r.url: (r.found, r.error) for r in copies.collect()} == {
        "u/hot": (True, None), "u/a": (True, None), "u/pdf": (True, None), "u/gone": (True, "timeout"), "u/none": (True, None), "u/missing": (False, None),
    }
    moved = lookup.bodies(copies.where("error IS NULL AND found"), pages)
    assert {r.url: (r.html or "")[:25] for r in moved.collect()} == {
        "u/hot": "<body><article>copy 399。T", "u/a": "<body><article>new。This i", "u/pdf": "%PDF", "u/none": ""
    }
    got = {r.url: r for r in lookup.first_results(urls, pages, "taken").collect()}
    assert {u: r.status for u, r in got.items()} == {
        "u/hot": "ok", "u/a": "ok", "u/pdf": "fetch_error", "u/gone": "fetch_error", "u/none": "none_found", "u/missing": "fetch_error"
    }
    assert got["u/missing"].error == lookup.MISSING_PAGE and got["u/pdf"].error == "Invalid URL"


def test_tables_without_files_are_stored_first(spark):
    pages = spark.createDataFrame([("u/a", 1, page("The first copy, longer than a line must be").decode())], "url string, page_id int, html string").unionByName(
        spark.createDataFrame([("u/a", 2, page("The second copy, longer than a line must be").decode())], "url string, page_id int, html string")
    )
    urls = spark.createDataFrame([("u/a",)], "url string")
    assert lookup.first_results(urls, pages).first().content.startswith("<p>The second copy")


def test_no_sort_or_aggregate_holds_bodies(spark, tmp_path):
    pages = snapshot(spark, str(tmp_path / "pages"), [("u/a", 1, "text/html", None, page("x"))])
    urls = spark.createDataFrame([("u/a",)], "url string")
    copies = lookup.latest_copies(urls, pages, "taken")
    for part in (lookup.bodies(copies, pages), lookup.first_results(urls, pages, "taken")):
        plan = part._jdf.queryExecution().explainString(part._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        for block in re.findall(r"\n\(\d+\) (?:Sort|\w*Aggregate)\b.*?(?=\n\n)", plan, flags=re.S):
            assert not re.search(r"\b(html|body)#", block), block
        assert "ShuffledHashJoin" in plan and "SinglePartition" not in plan.split("Subqueries")[0]


def nested(depth, text, attributes='class="content"'):
    return "<body>" + f"<div {attributes}>" * depth + text + "</div>" * depth + "</body>"


def test_nested_matches_cost_two_look_ups_each(spark):
    text = "<p>" + "word and more words " * 12 + "</p>"
    small = spark.createDataFrame([(1, nested(3, text))], "page_id long, html string")
    content.article_text(small, "page_id").collect()
    deep = spark.createDataFrame([(1, nested(2000, text * 5000))], "page_id long, html string")
    start = time.perf_counter()
    row = content.article_text(deep, "page_id").first()
    assert time.perf_counter() - start < 10
    assert row["rank"] == 8 and row["chars"] == 5000 * 240 - 1


@pytest.mark.parametrize("seed", range(4))
def test_measured_lengths_equal_those_of_built_texts(spark, seed):
    rnd = random.Random(seed)
    blanks = ["", " ", "\n\t", "　 ", "﻿"]
    documents = []
    for _ in range(40):
        texts = [rnd.choice([*blanks, "a", " b ", "語😀", "x" * rnd.randint(1, 200)]) for _ in range(rnd.randint(0, 150))]
        spans = sorted({tuple(sorted((rnd.randrange(-1, len(texts) or 1), rnd.randrange(-1, len(texts) or 1)))) for _ in range(rnd.randint(1, 6))}) if texts else []
        documents.append((len(documents), texts, [(a, b) for n, (a, b) in enumerate(spans) if n == 0 or a != spans[n - 1][0]]))
    table = spark.createDataFrame(documents, "id long, shown array<string>, spans array<struct<start_pos:int,end_pos:int>>")
    table = table.selectExpr("*", f"transform(shown, t -> {content.utf16_len('t')}) AS lengths", f"transform(shown, t -> {content.js_trim('t')} <> '') AS visible")
    table = table.selectExpr("*", f"{content._running('lengths')} AS running")
    for row in table.selectExpr("id", f"{content._measured('spans')} AS chars").collect():
        _, texts, spans = documents[row["id"]]
        text = "".join("".join(texts[max(a, 0) : b + 1]) for a, b in spans).strip(SPACES)
        assert row["chars"] == len(text.encode("utf-16-le")) // 2


# --- numbering by blocks ----------------------------------------------------------------
@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_renumbering_moves_no_content(spark, monkeypatch, broadcast):
    monkeypatch.setattr(order, "INDEX_BLOCK", 8)
    monkeypatch.setattr(order, "BLOCK", 4)
    monkeypatch.setattr(order, "MAX_BROADCAST_INDEX", broadcast)
    rnd = random.Random(1)
    ids = sorted(rnd.sample(range(600), 150)) + [10**6, 10**9, 10**9 + 1, 2**40] + [-5, -2000]
    rows = spark.createDataFrame([(i, "x" * 50) for i in rnd.sample(ids, len(ids))], "row_idx long, content string").repartition(5)
    numbered = order.renumber(rows)
    assert {r.row_idx: r.note_idx for r in numbered.collect()} == {i: n for n, i in enumerate(sorted(ids))}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and ("hashpartitioning(_block" in plan) == (not broadcast)
    assert order.renumber(rows.where("false")).count() == 0


def test_marks_count_failures_inside_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "INDEX_BLOCK", 16)
    monkeypatch.setattr(order, "BLOCK", 4)
    rnd = random.Random(2)
    rows = [(i, rnd.random() < 0.7) for i in sorted(rnd.sample(range(3000), 700)) + [10**7, 10**7 + 1]]
    table = spark.createDataFrame(rows, "row_idx long, success boolean")
    for interval in (1, 7, 100, 702, 703):
        want = [(n // interval, rows[n - 1][0], n, sum(not ok for _, ok in rows[:n])) for n in range(interval, len(rows) + 1, interval)]
        assert sorted(map(tuple, ledger.checkpoint_marks(table, interval).collect())) == want
    plan = ledger.checkpoint_marks(table, 7)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0]


def test_merged_runs_do_not_sort_or_aggregate_notes(spark):
    saved = spark.createDataFrame([(n, f"old {n}", 1) for n in range(40)], "row_idx long, content string, batch_id long")
    new = spark.createDataFrame([(n, f"new {n}", 2) for n in range(30, 60)], "row_idx long, content string, batch_id long")
    merged = ledger.merge_runs(saved, new)
    assert sorted((r.row_idx, r.content) for r in merged.collect()) == [(n, f"{'old' if n < 30 else 'new'} {n}") for n in range(60)]
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Sort" not in plan


def test_manifest_of_no_and_few_notes(spark):
    assert enex.manifest(spark.range(0), "b", 10).count() == 0
    parts = [tuple(r)[2:] for r in enex.manifest(spark.range(25), "b", 10).orderBy("part_no").collect()]
    assert parts == [(10, 0, 9, 10, 25, 3), (10, 10, 19, 20, 25, 3), (5, 20, 24, 25, 25, 3)]


def test_many_splits_are_ordered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW_SPLITS", 10)
    rnd = random.Random(4)
    splits = [(f"f/b_part{n:03d}.enex" if n % 3 else f"f/x{n}.csv", start, rnd.randint(1, 9), 0) for n in range(60) for start in (0, 100, 2000)]
    tagged = [(name, start, first + n) for name, start, rows, first in splits for n in range(rows)]
    table = spark.createDataFrame(rnd.sample(tagged, len(tagged)), "_file string, _start long, _seq long").select("*", F.concat("_file", F.lit("|"), "_start", F.lit("|"), "_seq").alias("row"))
    numbered = order.number_tagged(table)
    # Files without a part number come first, then parts by their number.
    want = sorted(tagged, key=lambda r: (int(r[0][8:11]) if "_part" in r[0] else -1, r[0], r[1], r[2]))
    assert {r.row: r.row_idx for r in numbered.collect()} == {f"{a}|{b}|{c}": n for n, (a, b, c) in enumerate(want)}
    totals = spark.createDataFrame(splits, "_file string, _start long, _rows long, _first long")
    plan = order._split_offsets(totals, len(splits), order.shared_dir(spark, "ranges"))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Subquery")[0]
