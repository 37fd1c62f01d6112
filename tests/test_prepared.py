"""Prepared pages, progress of a stream, documents as of a count."""

import re

import pytest

from noteweave.operators import ledger, lookup
from noteweave.sources.pages import PreparedPages, prepare_pages
from noteweave.streaming.progress import read_progress, write_progress

TEXT = "A sentence that is long enough to be kept as a line of the article. " * 2


def snapshot(spark, *rows):
    return spark.createDataFrame([(n, u, t, e, b.encode() if b is not None else None) for n, u, t, e, b in rows], "page_id long, url string, content_type string, error string, body binary")


def page(word):
    return f"<body><article>{word} {TEXT}</article></body>"


def held(table):
    return {r.url: (r.taken, r.error, bytes(r.body).decode()[15:19] if r.body is not None else None) for r in table.collect()}


def test_snapshots_are_merged_as_versions(spark, tmp_path):
    path = str(tmp_path / "pages")
    with pytest.raises(ValueError, match="no prepared pages"):
        PreparedPages(path).table(spark)
    html = "text/html"
    prepare_pages(spark, path, snapshot(spark, (1, "u/a", html, None, page("aaa1")), (2, "u/a", html, None, page("aaa2")), (9, "u/b", html, None, page("bbb9")), (3, None, html, None, page("none"))), buckets=4)
    new = snapshot(spark, (5, "u/a", html, None, page("aaa5")), (4, "u/b", html, None, page("bbb4")), (6, "u/c", html, "timeout", None))
    prepared = prepare_pages(spark, path, new, buckets=99)
    assert held(prepared.table(spark, 1)) == {"u/a": (2, None, "aaa2"), "u/b": (9, None, "bbb9")}
    assert held(prepared.table(spark)) == {"u/a": (5, None, "aaa5"), "u/b": (9, None, "bbb9"), "u/c": (6, "timeout", None)}
    assert [v["buckets"] for v in prepared.versions(spark)] == [4, 4]
    # Another session reads the same folder.
    other = spark.newSession()
    assert held(PreparedPages(path).table(other)) == held(prepared.table(spark))
    prepare_pages(spark, path, new.limit(0))
    assert held(prepared.table(spark)) == held(prepared.table(spark, 2))


def test_bodies_of_prepared_pages_stay_in_their_buckets(spark, tmp_path):
    rows = [(n, f"u/{n % 40}", "text/html" if n % 7 else "image/png", "timeout" if n % 11 == 5 else None, page(f"p{n:03}")) for n in range(90)]
    pages = snapshot(spark, *rows)
    prepared = prepare_pages(spark, str(tmp_path / "pages"), pages, buckets=8)
    urls = spark.createDataFrame([(f"u/{n}",) for n in range(0, 60, 2)], "url string")
    got = {r.url: tuple(r) for r in lookup.first_results(urls, prepared).collect()}
    assert got == {r.url: tuple(r) for r in lookup.first_results(urls, pages).collect()} and len(got) == 30
    moved = lookup.prepared_bodies(urls, prepared.table(spark))
    plan = moved._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    # One exchange, of the urls; the scan of the table is bucketed and feeds the join as it is.
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "Sort" not in plan
    assert not re.search(r"Exchange[^\n]*\n[^\n]*body", plan)


def test_totals_of_a_stream_come_from_the_batch_before(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert read_progress(spark, path).count() == 0
    for batch, processed, failed in ((0, 10, 1), (1, 5, 0), (1, 5, 0), (2, 7, 7)):  # batch 1 runs again
        write_progress(spark, path, batch, {"processed": processed, "failed": failed})
    assert [tuple(r) for r in read_progress(spark, path).orderBy("batch_id").collect()] == [(0, 10, 1, 10, 1), (1, 5, 0, 15, 1), (2, 7, 7, 22, 8)]


@pytest.mark.parametrize("count", [0, 1, 7, 1499, 1500, 9999])
def test_notes_as_of_a_count(spark, count):
    ids = [n * 3 + n // 7 * 1000 for n in range(1500)]
    rows = spark.createDataFrame([(i,) for i in reversed(ids)], "row_idx long")
    assert sorted(r.row_idx for r in ledger.notes_as_of(rows, count).collect()) == ids[:count]
    plan = ledger.notes_as_of(rows, count)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Sort" not in plan.split("Subquery")[0]
