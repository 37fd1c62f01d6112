"""Cases on which earlier versions lost data, stalled or miscounted; expected values are literal."""

import time

import pytest
from pyspark.sql import functions as F

from noteweave.functions.html import attribute, decode_entities, tokens
from noteweave.operators import content, ledger
from noteweave.sources.ledger import append_ledger, read_ledger


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("page", ["<a " * 700_000, '<a b="' * 350_000, "<!x" * 700_000, "<a b='" + "<p x=" * 400_000, "<script " * 250_000])
def test_open_markup_is_read_in_linear_time(spark, page):
    one(spark, "<a>", tokens)
    start = time.perf_counter()
    found = one(spark, page, tokens)
    assert "".join(found) == page and time.perf_counter() - start < 10


@pytest.mark.parametrize(
    "page, want",
    [
        ("x<p", ["x", "<p"]),
        ("<p a='1'>x<b c=\"y>z", ["<p a='1'>", "x", '<b c="y>z']),
        ("<p a=\"x>y\">z</p>", ['<p a="x>y">', "z", "</p>"]),
        ("a<!doctype", ["a", "<!doctype"]),
        ("a < b", ["a ", "<", " b"]),
    ],
)
def test_tokens(spark, page, want):
    assert one(spark, page, tokens) == want


@pytest.mark.parametrize(
    "tag, want",
    [
        ("<div class=ads>", "ads"),
        ("<div title=' class=\"ads\"' class='x y'>", "x y"),
        ("<div title=' class=\"ads\"'>", ""),
        ("<div data-class='no' CLASS = \"yes\">", "yes"),
        ("<div class class='second'>", "second"),
        ("<div hidden id=a/ class=b>", "b"),
        ("<div a='1'class='2'>", "2"),
        ("<class='x'>", ""),
        ("<div>", ""),
    ],
)
def test_attributes_are_walked_in_order(spark, tag, want):
    assert one(spark, tag, lambda t: attribute(t, "class")) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("&check; &lbrack; a&NewLine;b", "✓ [ a\nb"),
        ("&notit; &notin; &ampx &amp;lt;", "¬it; ∉ &x &lt;"),
        ("&copy 2024 &unknown; & &; &#x41;&#66", "© 2024 &unknown; & &; AB"),
        ("&fjlig;&NotEqualTilde;", "fj≂̸"),
    ],
)
def test_all_entity_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").selectExpr(f"{decode_entities('x')} AS y").first()["y"] == want


def test_visible_text_is_measured_with_single_blanks(spark):
    page = "<body><div>" + ("<p>ab</p>\n" + " " * 30) * 6 + "</div></body>"
    rows = spark.createDataFrame([(1, "https://e.com/", page)], "page_id long, url string, html string")
    assert content.extract(rows, "page_id", rendered=True).first()["status"] == "too_short"


LEDGER_ROWS = "row_idx long, url string, method string, success boolean, error string, batch_id long, processed_at timestamp"


def ledger_table(spark, ids):
    return spark.createDataFrame([(i, "u", "m", i % 4 != 0, None, 0, None) for i in ids], LEDGER_ROWS)


def test_marks_count_processed_rows(spark):
    ids = [1, 2, 7, 100, 101, 250, 900, 5000, 70_000]
    marks = [tuple(r) for r in ledger.checkpoint_marks(ledger_table(spark, ids), 3).orderBy("mark_no").collect()]
    assert marks == [(1, 7, 3, 0), (2, 250, 6, 1), (3, 70_000, 9, 4)]
    assert [r.mark_no for r in ledger.checkpoint_marks(ledger_table(spark, ids[:5]), 3).collect()] == [1]


def test_reports_do_not_skip_unreadable_ledger_files(spark, tmp_path):
    path = str(tmp_path / "ledger")
    append_ledger(ledger_table(spark, range(5)), path)
    (tmp_path / "ledger" / "batch_id=0" / "part-broken.parquet").write_bytes(b"no parquet")
    assert read_ledger(spark, path, tolerant=True).count() == 5
    with pytest.raises(Exception, match="(?i)parquet"):
        read_ledger(spark, path).agg(F.max("row_idx")).collect()


def test_run_time_gives_a_rate(spark):
    stats = ledger.run_stats(ledger_table(spark, range(10)), total=12, seconds=5.0).first()
    assert (stats.processed, stats.total, stats.rows_per_second, stats.elapsed_minutes) == (10, 12, 2.0, 0.1)
