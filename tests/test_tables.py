"""Numbering, joins, notes, ledger, documents, jobs and streaming."""

import pytest
from pyspark.sql import functions as F

from noteweave.operators import enex, joins, ledger, lookup, notes, order
from noteweave.plans import jobs
from noteweave.sources.bookmarks import read_bookmarks
from noteweave.sources.enex import read_enex, read_enex_header, write_parts
from noteweave.sources.ledger import append_ledger, read_ledger
from noteweave.streaming.intake import start_intake

DAY = "2024-01-31"
STAMP = "20240131T000000Z"
LONG = "A sentence of the article that is long enough to count as content in the end. " * 2
COLUMNS = "row_idx long, title string, url string, time_added string, tags string, status string"


def write_csv(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("title,url,time_added,tags,status\n" + "\n".join(lines) + "\n", encoding="utf8")


# --- order -----------------------------------------------------------------------
def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for part in range(3):
        write_csv(tmp_path / "in", f"b{part}.csv", [f"t{part}-{i},https://e.com/{part}/{i},0,,read" for i in range(500)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_bookmarks(spark, str(tmp_path / "in"))
        got = [r.title for r in rows.orderBy("row_idx").collect()]
        assert [r.row_idx for r in rows.orderBy("row_idx").collect()] == list(range(1500))
        assert rows.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"t{part}-{i}" for part in range(3) for i in range(500)]


def test_csv_quotes_and_bad_rows(spark, tmp_path):
    lines = ['"say ""hi"", ok",https://e.com,1,"a,b",read', "t,https://e.com,1,tag1,tag2,unread", "t,https://e.com"]
    write_csv(tmp_path / "in", "b.csv", lines)
    rows = read_bookmarks(spark, str(tmp_path / "in")).orderBy("row_idx").collect()
    assert rows[0].title == 'say "hi", ok' and rows[0].tags == "a,b" and rows[0]._corrupt_record is None
    assert (rows[1].tags, rows[1].status) == ("tag1", "tag2") and rows[1]._corrupt_record
    assert rows[2].status is None and rows[2]._corrupt_record


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    write_csv(tmp_path / "in", "b.csv", ['"two\nlines",https://e.com,1,,read', "x,https://e.com,2,,read"])
    rows = read_bookmarks(spark, str(tmp_path / "in"), multi_line=True).orderBy("row_idx").collect()
    assert [r.title for r in rows] == ["two\nlines", "x"]


def test_running_totals_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK", 7)
    table = spark.range(0, 500).where("id % 3 <> 1").withColumn("v", F.col("id") % 5)
    rows = order.running_totals(table, "id", total=F.col("v")).orderBy("id").collect()
    running = 0
    for row in rows:
        running += row.v
        assert row.total == running
    dense = order.renumber(table, "id", "n").orderBy("id").collect()
    assert [r.n for r in dense] == list(range(len(dense)))


def test_sizes_must_be_positive(spark):
    for size in (0, -1):
        with pytest.raises(ValueError):
            order.part_number(size)
        with pytest.raises(ValueError):
            order.batch_number(size)


def test_part_names_do_not_truncate(spark):
    row = spark.range(1).select(order.part_name("a", F.lit(7)).alias("x"), order.part_name("a", F.lit(1234)).alias("y"))
    assert tuple(row.first()) == ("a_part007.enex", "a_part1234.enex")


# --- joins -----------------------------------------------------------------------------
def test_left_lookup_with_a_hot_key(spark):
    rows = spark.range(0, 3000).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
    )
    table = spark.createDataFrame([("hot", 1), ("k5", 2), ("unused", 3)], "k string, v int")
    got = joins.left_lookup(rows, table, "k", "row_idx")
    plain = rows.join(table, "k", "left")
    assert got.count() == 3000
    assert sorted(map(str, got.select("row_idx", "k", "v").collect())) == sorted(map(str, plain.select("row_idx", "k", "v").collect()))
    assert [(k, round(part, 2)) for k, part in joins.hot_keys(rows, "k")] == [("hot", 0.34)]


def test_hot_list_is_bounded(spark):
    rows = spark.range(0, 1000).select((F.col("id") % 10).alias("k"))
    assert len(joins.hot_keys(rows, "k", share=20)) == 10
    assert joins.hot_keys(rows, "k", share=10) == [] and joins.hot_keys(rows.where("false"), "k") == []


def test_pieces_follow_the_share_of_a_key(spark):
    rows = spark.range(0, 40_000).select(F.col("id").alias("row_idx"), F.when(F.col("id") % 2 == 0, "half").when(F.col("id") % 10 == 1, "tenth").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"))
    table = spark.createDataFrame([("half", 1), ("tenth", 2), ("k3", 3)], "k string, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.left_lookup(rows, table, "k", "row_idx").select("v", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"), F.count("v").alias("met")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = sorted(r.n for r in joined)
    assert sum(sizes) == 40_000 and sum(r.met for r in joined) == 24_001
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


# --- notes --------------------------------------------------------------------------------
def bookmarks(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLUMNS)


def test_plain_note(spark):
    note = notes.make_notes(
        bookmarks(spark, ("Test Article", "https://example.com/test", "1507018057", "tag1,tag2,tag3", "unread")), DAY
    ).first()
    assert (note.title, note.created, note.updated) == ("Test Article", "20171003T080737Z", "20171003T080737Z")
    assert note.tag == ["tag1", "tag2", "tag3"]
    assert note.note_attributes.source_url == "https://example.com/test"
    assert note.note_attributes.source == "web.clip"
    assert note.content == (
        '<?xml version="1.0" encoding="UTF-8" standalone="no"?>\n'
        '<!DOCTYPE en-note SYSTEM "http://xml.evernote.com/pub/enml2.dtd">\n<en-note>\n\n<div>\n'
        '<a href="https://example.com/test">Test Article</a>\n</div>\n<div>\n<br/>\n</div>\n<div>\n'
        "URL: https://example.com/test\n</div>\n<div>\nStatus: unread\n</div>\n</en-note>"
    )


def test_note_edge_rows(spark):
    rows = bookmarks(
        spark,
        ("", "https://example.com/a", "0", "", ""),
        (None, "https://example.com/b", "0", None, None),
        ('<script>alert("x")</script>', 'https://e.com/s?p=<value>&o="q"', "1", "t1, t2 ,,t3", "read"),
        ("a\x00\x0bb", "https://e.com/\x0e", "x", "", "unread"),
        (None, None, None, None, None),
        ("記" * 16000, "https://e.com", "1", "テスト,日本語", "unread"),
    )
    got = notes.make_notes(rows, DAY).orderBy("row_idx").collect()
    assert len(got) == 6
    assert (got[0].title, got[0].tag, got[0].created) == ("https://example.com/a", None, "19700101T000000Z")
    assert "Status: \n" in got[1].content and got[1].title == "https://example.com/b"
    assert "<script>" not in got[2].content and got[2].tag == ["t1", " t2 ", "t3"]
    assert got[2].note_attributes.source_url == "https://e.com/s?p=&lt;value&gt;&amp;o=&quot;q&quot;"
    assert (got[3].title, got[3].created, got[3].note_attributes.source_url) == ("ab", None, "https://e.com/")
    assert got[4].title == "" and got[4].content is not None
    assert len(got[5].title) == 16000


def test_note_with_content(spark):
    rows = bookmarks(spark, ("T", "https://e.com", "1", "", "read"), ("T", "https://e.com", "1", "", "read"))
    rows = rows.withColumn("page_content", F.when(F.col("row_idx") == 0, F.lit("<p>" + "x" * 100_000 + "\x01</p>")).otherwise(F.lit("")))
    full, empty = notes.make_notes(rows, DAY).orderBy("row_idx").collect()
    assert f"<hr/>\n<div>\n<p>{'x' * 100_000}</p>\n</div>\n<hr/>" in full.content
    assert f"Scraped: {DAY}\n</small>" in full.content and "<h1>T</h1>" in full.content
    assert "<h1>" not in empty.content


def test_quarantine(spark):
    rows = bookmarks(
        spark, ("ok", "https://e.com", "1", "a", "read"), ("bad", "https://e.com", "1", "a\x0b,b", "read"), ("x￾", "https://e.com/￿", "1", "", "")
    )
    good, bad = notes.quarantine(notes.make_notes(rows, DAY))
    assert [r.row_idx for r in good.collect()] == [0]
    assert {r.row_idx: r.reason for r in bad.collect()} == {1: "tag", 2: "title,content,source_url"}


# --- page lookup ------------------------------------------------------------------------------
def page_table(spark, *rows):
    return spark.createDataFrame(
        [(i, u, t, bytearray(b, "utf8") if b is not None else None, e) for i, (u, t, b, e) in enumerate(rows)],
        "page_id int, url string, content_type string, body binary, error string",
    )


def test_lookup_keeps_every_bookmark(spark):
    good = f"<body><article>{LONG}</article></body>"
    pages = page_table(
        spark,
        ("https://e.com/good", "text/html", "<body>old copy</body>", None),
        ("https://e.com/good", "text/html; charset=utf-8", good, None),
        ("https://e.com/short", "text/html", "<body>x</body>", None),
        ("https://e.com/error", None, None, "timeout of 7000ms exceeded"),
        ("https://e.com/Data.JSON", "application/json; v=1", "{}", None),
        ("https://e.com/short2", "text/html", "<body>x</body>", None),
        ("https://e.com/unused", "text/html", good, None),
        ("https://e.com/file.pdf", "text/html", good, None),
    )
    rendered = spark.createDataFrame([("https://e.com/short2", good), ("https://e.com/good", "<body>not used</body>")], "url string, html string")
    names = ["good", "short", "error", "Data.JSON", "short2", "missing", "file.pdf", "good"]
    rows = bookmarks(spark, *[("t", f"https://e.com/{n}", "1", "", "read") for n in names], ("t", None, "1", "", "read"))
    got = lookup.add_page_content(rows, pages, rendered).orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(9))
    assert [r.success for r in got] == [True, False, False, True, True, False, True, True, False]
    assert [r.method for r in got] == [
        "lightweight", "failed", "failed", "lightweight", "browser", "failed", "lightweight", "lightweight", "failed",
    ]
    assert got[0].page_content == got[7].page_content
    assert got[0].page_content.endswith("。</p>\n\n<p><small>[Scraped via HTTP]</small></p>")
    assert got[1].page_content.startswith("<p>Failed to scrape content from https://e.com/short (browser): ")
    assert "Content-Type: application/json</small>" in got[3].page_content and ">Data.JSON</a>" in got[3].page_content
    assert got[4].page_content.endswith("[Scraped via Browser]</small></p>")
    assert got[6].route == "url_stub" and "PDF document" in got[6].page_content
    plain = lookup.add_page_content(rows, pages).orderBy("row_idx").collect()
    assert plain[1].page_content == "<p>Content could not be extracted from https://e.com/short</p>\n<p><small>[Scraping Failed]</small></p>"
    assert plain[2].page_content.startswith("<p>Failed to scrape content from https://e.com/error: timeout of 7000ms exceeded</p>")
    assert plain[4].success is False
    made = notes.make_notes(lookup.add_page_content(rows, pages), DAY)
    assert made.count() == 9
    assert {(r.method, r.success): r.n for r in ledger.breakdown(lookup.add_page_content(rows, pages)).collect()} == {
        ("lightweight", True): 4, ("failed", False): 5,
    }


# --- ledger --------------------------------------------------------------------------------------
LEDGER = "row_idx long, url string, method string, success boolean, error string, batch_id long, processed_at timestamp"


def ledger_rows(spark, count, failed=()):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, f"u{i}", "lightweight", i not in failed, None, i // 10, start + timedelta(seconds=2 * i)) for i in range(count)]
    return spark.createDataFrame(rows, LEDGER)


def test_run_stats(spark):
    row = ledger.run_stats(ledger_rows(spark, 80, failed={3, 70}), total=100).first()
    assert (row.processed, row.total, row.failed, row.last_row_idx, row.success_rate) == (80, 100, 2, 79, 97.5)
    assert (row.rows_per_second, row.elapsed_minutes, row.checkpoints) == (0.51, 2.6, 0)
    empty = ledger.run_stats(ledger_rows(spark, 80).limit(0)).first()
    assert (empty.processed, empty.success_rate, empty.last_row_idx, empty.checkpoints) == (0, None, -1, 0)


def test_failures_and_marks(spark):
    table = ledger_rows(spark, 105, failed=set(range(0, 60, 5)))
    top = ledger.first_failures(table).collect()
    assert [r.row_idx for r in top] == list(range(0, 50, 5))
    assert {(r.failures, r.not_shown) for r in top} == {(12, 2)} and top[0].record_id == "record_0"
    marks = ledger.checkpoint_marks(table, 20).orderBy("mark_no").collect()
    assert [(m.mark_no, m.last_row_idx, m.processed, m.failed) for m in marks] == [
        (1, 19, 20, 4), (2, 39, 40, 8), (3, 59, 60, 12), (4, 79, 80, 12), (5, 99, 100, 12),
    ]
    assert ledger.checkpoint_marks(ledger_rows(spark, 1), 2).count() == 0
    assert ledger.checkpoint_marks(ledger_rows(spark, 2), 2).count() == 1


def test_ledger_is_tolerant(spark, tmp_path):
    assert read_ledger(spark, str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.parquet").write_text("invalid json")
    assert read_ledger(spark, str(bad), tolerant=True).count() == 0
    path = str(tmp_path / "ledger")
    append_ledger(ledger_rows(spark, 20), path)
    append_ledger(ledger_rows(spark, 20).where("batch_id = 1"), path)
    append_ledger(ledger_rows(spark, 30).where("batch_id = 2"), path)
    assert read_ledger(spark, path).count() == 30


def test_resume_filters(spark):
    rows = spark.range(0, 20).select(F.col("id").alias("row_idx"))
    done = ledger_rows(spark, 10).where("row_idx <> 4")
    assert ledger.after_last(rows, done).count() == 10
    assert sorted(r.row_idx for r in ledger.not_processed(rows, done).collect()) == [4, *range(10, 20)]
    assert ledger.after_last(rows, done.limit(0)).count() == 20


# --- documents ---------------------------------------------------------------------------------------
def many(spark, count):
    return bookmarks(spark, *[(f"Title & {i} ]]>", f"https://e.com/{i}?a=1&b='2'", str(i), f"tag{i},c & d", "read") for i in range(count)])


def test_parts_are_whole_documents(spark, tmp_path):
    import xml.dom.minidom

    made = notes.make_notes(many(spark, 25).where("row_idx <> 3"), DAY)
    lines = enex.document_lines(made, "base", STAMP, 10)
    for _ in range(2):  # written again, the parts replace the earlier ones
        write_parts(lines, str(tmp_path / "parts"))
    files = sorted(p for p in (tmp_path / "parts").iterdir() if not p.name.startswith("."))
    assert [p.name for p in files] == [f"base_part{n:03d}.enex" for n in (1, 2, 3)]
    counts = []
    for file in files:
        document = file.read_text(encoding="utf8")
        assert document.startswith('<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE en-export SYSTEM ')
        assert document.rstrip().endswith("</en-export>")
        tree = xml.dom.minidom.parseString(document)
        assert tree.documentElement.getAttribute("export-date") == STAMP
        counts.append(len(tree.getElementsByTagName("note")))
    assert counts == [10, 10, 4]
    manifest = enex.manifest(order.renumber(made), "base", 10).orderBy("part_no").collect()
    assert [(m.notes, m.running_notes, m.total_notes, m.total_parts) for m in manifest] == [(10, 10, 24, 3), (10, 20, 24, 3), (4, 24, 24, 3)]


def test_round_trip(spark, tmp_path):
    made = notes.make_notes(many(spark, 25), DAY)
    path = str(tmp_path / "parts")
    write_parts(enex.document_lines(made, "base", STAMP, 10), path)
    back = read_enex(spark, path)
    columns = ["row_idx", "title", "content", "created", "updated", "note_attributes", "tag"]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, made.select(*columns).collect()))
    assert read_enex_header(spark, path) == {"export_date": STAMP, "application": "Evernote", "version": "10.0"}


# --- jobs ----------------------------------------------------------------------------------------------
def note_rows(spark, path):
    table = spark.read.parquet(path).drop("batch_id")
    return sorted(map(str, table.collect()))


def test_convert_resume_and_split(spark, tmp_path):
    source = tmp_path / "in"
    write_csv(source, "b.csv", [f"t{i},https://e.com/{i % 4},{i},a,read" for i in range(12)])
    pages = page_table(spark, *[(f"https://e.com/{i}", "text/html", f"<body><article>{LONG}{i}</article></body>", None) for i in range(3)])
    whole, steps = str(tmp_path / "whole"), str(tmp_path / "steps")
    options = {"day": DAY, "export_date": STAMP, "pages": pages, "notes_per_part": 5}
    stats = jobs.convert(spark, str(source), whole, **options).first()
    assert (stats.processed, stats.failed) == (12, 3)
    jobs.convert(spark, str(source), steps, limit=5, **options)
    stats = jobs.convert(spark, str(source), steps, resume=True, **options).first()
    assert (stats.processed, stats.failed) == (12, 3)
    again = jobs.convert(spark, str(source), steps, resume=True, **options).first()
    assert again.processed == 12
    assert note_rows(spark, f"{whole}/notes") == note_rows(spark, f"{steps}/notes")
    one = read_enex(spark, f"{whole}/parts").drop("base_name")
    two = read_enex(spark, f"{steps}/parts").drop("base_name")
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 12

    manifest = jobs.split(spark, f"{whole}/parts", str(tmp_path / "split"), 4)
    assert [m.notes for m in manifest.orderBy("part_no").collect()] == [4, 4, 4]
    parts = read_enex(spark, str(tmp_path / "split/parts")).drop("base_name")
    assert sorted(map(str, parts.collect())) == sorted(map(str, one.collect()))
    with pytest.raises(ValueError):
        jobs.split(spark, f"{whole}/parts", str(tmp_path / "split0"), 0)


def test_stream_equals_batch_and_does_not_repeat(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    pages = page_table(spark, ("https://e.com/0", "text/html", f"<body><article>{LONG}</article></body>", None))

    def run():
        query = start_intake(spark, str(source), out, str(tmp_path / "checkpoint"), DAY, pages, files_per_batch=1)
        query.awaitTermination()

    for part in range(2):
        write_csv(source, f"b{part}.csv", [f"t{part}{i},https://e.com/{i % 2},{i},a,read" for i in range(4)])
    run()
    run()
    assert read_ledger(spark, f"{out}/ledger").count() == 8
    write_csv(source, "b2.csv", ["late,https://e.com/0,9,a,read"])
    run()
    table = read_ledger(spark, f"{out}/ledger")
    assert table.count() == 9 and table.where("NOT success").count() == 4
    metrics = ledger.batch_metrics(table).orderBy("batch_id").collect()
    assert [(m.processed, m.total_processed, m.total_failed) for m in metrics] == [(4, 4, 2), (4, 8, 4), (1, 9, 4)]
    columns = ["title", "content", "created", "note_attributes", "tag"]
    batch = notes.make_notes(lookup.add_page_content(read_bookmarks(spark, str(source)), pages), DAY).select(*columns)
    streamed = spark.read.parquet(f"{out}/notes").select(*columns)
    assert sorted(map(str, batch.collect())) == sorted(map(str, streamed.collect()))
