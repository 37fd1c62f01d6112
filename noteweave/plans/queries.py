"""Registered queries: every operator over the given tables.

Each function takes a session and a table folder and returns flat columns.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import charset, fixed, sqltext, text, urls
from noteweave.functions.notes import add_method_label
from noteweave.operators import content, elements, enex, ledger, lookup, notes, order
from noteweave.session import configure, shared_dir
from noteweave.sources.bookmarks import CSV_OPTIONS, bookmarks_from_pages, read_bookmarks
from noteweave.sources.enex import note_blocks, read_enclosure, read_enex, write_parts
from noteweave.sources.ledger import read_ledger
from noteweave.sources.pages import PreparedPages, prepare_pages
from noteweave.sources.tables import read_table, spread
from noteweave.streaming.intake import start_intake
from noteweave.streaming.progress import read_progress

DAY = "2024-01-31"
EXPORT_DATE = "20240131T000000Z"
INTERVAL = 100
PAGES_PER_PART = 40
DOCUMENTS_PER_PART = 300


def _pages(spark: SparkSession, sf: str, key: str = "page_id") -> DataFrame:
    return spread(read_table(configure(spark), sf, "pages"), key)


def _bookmarks(spark: SparkSession, sf: str) -> DataFrame:
    return bookmarks_from_pages(read_table(configure(spark), sf, "pages"))


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(read_table(configure(spark), sf, "documents"), "doc_id")


def _events_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The event table read as a processing ledger."""
    return read_table(configure(spark), sf, "events").select(
        F.expr("event_id * 2 + event_id div 9 * 1000").alias("row_idx"),  # with gaps
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("url"),
        (F.col("event_type") != "error").alias("success"),
        F.col("ts").cast("timestamp").alias("processed_at"),
    )


def varied_html(html: Column, index: Column) -> Column:
    """Page markup with other containers, so that all kinds of rules apply."""
    openings = [
        "<article>",
        '<article><div class="note content">',
        "<main>",
        '<div id="content">',
        '<div class="post-body">',
        '<section role="main">',
        "<div>",
        '<article><div class="share">x</div>',
    ]
    closings = ["</article>", "</div></article>", "</main>", "</div>", "</div>", "</section>", "</div>", "</article>"]
    kind = (index % 8 + 1).cast("int")
    opened = F.replace(html, F.lit("<article>"), F.element_at(F.array(*map(F.lit, openings)), kind))
    closed = F.replace(opened, F.lit("</article>"), F.element_at(F.array(*map(F.lit, closings)), kind))
    banner = F.when(index % 3 == 0, F.lit('class="ads wide"')).otherwise(F.lit('class="ad"'))
    return F.replace(closed, F.lit('class="ad"'), banner)


def _varied_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf)
    return pages.withColumn("html", varied_html(F.col("html"), F.col("page_id")))


def flat_columns() -> list:
    """Note columns without nesting; tags joined by ``|``."""
    return [
        "title",
        "content",
        "created",
        "updated",
        F.col("note_attributes.author").alias("author"),
        F.col("note_attributes.source").alias("source"),
        F.col("note_attributes.source_url").alias("source_url"),
        F.array_join("tag", "|").alias("tags"),
    ]


def flat(table: DataFrame, *keep: str) -> DataFrame:
    return table.select(*keep, *flat_columns())


# --- bookmarks and plain notes --------------------------------------------------
def bookmark_rows(spark, sf):
    rows = _bookmarks(spark, sf)
    return rows.withColumn("title_or_url", F.coalesce(F.nullif("title", F.lit("")), "url"))


def limit_rows(spark, sf):
    return order.first_rows(_bookmarks(spark, sf), 100).select(
        "row_idx", "url", order.batch_number(10).alias("batch_no")
    )


def notes_plain(spark, sf):
    return flat(notes.make_notes(_bookmarks(spark, sf), DAY), "row_idx")


def note_tags(spark, sf):
    return notes.explode_tags(notes.make_notes(_bookmarks(spark, sf), DAY), "row_idx")


def document_notes(spark, sf):
    rows = _documents(spark, sf).select(
        F.col("doc_id").alias("row_idx"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),  # the first line
        F.concat(F.lit("https://docs.example.org/"), F.col("source"), F.lit("?id="), F.col("doc_id").cast("string"), F.lit("&x='1'")).alias("url"),
        F.col("doc_id").cast("string").alias("time_added"),
        F.col("lang").alias("tags"),
        F.lit("read").alias("status"),
        F.concat(F.lit("<p>"), text.escape_markup(F.col("text")), F.lit("</p>\n")).alias("page_content"),
    )
    return flat(notes.make_notes(rows, DAY), "row_idx")


# --- URL and body routing -----------------------------------------------------------
def url_file_class(spark, sf):
    return _bookmarks(spark, sf).select(
        "row_idx",
        "url",
        urls.is_binary_url("url").alias("is_file"),
        urls.file_class("url").alias("file_class"),
        urls.file_name(F.lower(urls.url_path(F.col("url")))).alias("file_name"),
        urls.file_stub("url").alias("stub"),
    )


def content_type_route(spark, sf):
    kinds = ["text/html; charset=utf-8", "text/plain", "application/pdf ; v=1", "", "image/svg+xml"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("page_id") % 5 + 1).cast("int"))
    pages = read_table(configure(spark), sf, "pages").select("page_id", "url", kind.alias("content_type"))
    is_text = urls.is_text_type(F.col("content_type"))
    return pages.select(
        "page_id",
        "content_type",
        is_text.alias("is_text"),
        urls.mime_type(F.col("content_type")).alias("mime"),
        F.when(~is_text, urls.content_type_stub(F.col("url"), F.col("content_type"))).alias("stub"),
    )


CHARSET_FORMS = ["charset=EUC-JP", "charset=euc-jp", "charset=Shift_JIS", "charset=shift_jis", 'charset="utf-8"']


def page_charset(spark, sf):
    form = F.element_at(F.array(*map(F.lit, CHARSET_FORMS)), (F.col("page_id") % 5 + 1).cast("int"))
    html = F.replace("html", F.lit('charset="utf-8"'), form)
    return _pages(spark, sf).select(
        "page_id", charset.detect_charset(F.encode(html, "UTF-8")).alias("charset")
    )


def page_decode(spark, sf):
    form = F.element_at(F.array(*map(F.lit, CHARSET_FORMS)), (F.col("page_id") % 5 + 1).cast("int"))
    kind = F.col("page_id") % 5
    marked = F.replace("html", F.lit('charset="utf-8"'), form)
    # The Japanese charsets lack the letters of the pages' languages; they get one that they hold.
    held = F.when(kind < 4, F.regexp_replace(marked, r"[^\x00-\x7f]", "\u8a9e")).otherwise(marked)
    page = F.concat(held, F.lit("\u65e5\u672c\u8a9e"), F.col("page_id").cast("string"))
    body = (
        F.when(kind < 2, F.encode(page, "EUC-JP"))
        .when(kind < 4, F.encode(page, "Shift_JIS"))
        .otherwise(F.encode(page, "UTF-8"))
    )
    return _pages(spark, sf).select("page_id", charset.decode_body(body).alias("decoded"))


# --- content extraction -----------------------------------------------------------------
def html_tokens(spark, sf):
    return elements.html_tokens(_pages(spark, sf), "page_id")


def element_spans(spark, sf):
    events = elements.tag_events(_varied_pages(spark, sf), "page_id")
    spans = elements.visible_spans(elements.element_spans(events, "page_id"), "page_id")
    relevant = F.col("dropped") | F.col("inner_drop") | (F.size("ranks") > 0)
    return spans.where(relevant).select(
        "page_id", "tag", "start_pos", "end_pos", "dropped", F.col("inner_drop").alias("inner"), "hidden",
        F.array_join(F.array_sort("ranks"), ",").alias("ranks"),
    )


def page_stripped_text(spark, sf):
    return content.stripped_text(_varied_pages(spark, sf), "page_id")


def content_pick(spark, sf):
    picked = content.pick_content(content.page_texts(_varied_pages(spark, sf), "page_id"))
    return picked.select("page_id", "pick.rank", "pick.start_pos", "pick.end_pos", "pick.chars")


def longest_block(spark, sf):
    return content.longest_block(_varied_pages(spark, sf), "page_id")


def article_text(spark, sf):
    return content.article_text(_varied_pages(spark, sf), "page_id")


def document_paragraphs(spark, sf):
    sentences = F.replace("text", F.lit(". "), F.lit(fixed.SENTENCE_END))
    packed = F.expr(sqltext.pack_paragraphs(sqltext.text_lines("sentences")))
    documents = _documents(spark, sf).select("doc_id", sentences.alias("sentences"))
    return documents.select("doc_id", F.posexplode_outer(packed).alias("para_no", "paragraph")).where("para_no IS NOT NULL")


def page_enml(spark, sf):
    pages = _varied_pages(spark, sf)
    pages = pages.withColumn("html", F.replace("html", F.lit(". "), F.lit(fixed.SENTENCE_END)))
    return content.extract(pages, "page_id").select("page_id", "content", "status")


# --- page lookup ----------------------------------------------------------------------------
def _http_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_id") % 6 != 5)


def _rendered_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("page_id") % 12 == 5)


def _looked_up(spark, sf, fallback: bool) -> DataFrame:
    pages = read_table(configure(spark), sf, "pages")
    rendered = _rendered_pages(pages) if fallback else None
    return lookup.add_page_content(_bookmarks(spark, sf), _http_pages(pages), rendered)


_LOOKUP_COLUMNS = ["row_idx", "url", "route", "method", "page_status", "page_error", "success", "page_content"]


def scrape_join(spark, sf):
    return _looked_up(spark, sf, fallback=False).select(*_LOOKUP_COLUMNS)


def fallback_chain(spark, sf):
    return _looked_up(spark, sf, fallback=True).select(*_LOOKUP_COLUMNS)


COMMON_URL = "https://common.example.org/start?a=<b>"
SNAPSHOT_TYPES = ["text/html; charset=euc-jp", "text/html", "text/html", "text/plain; charset=utf-8", "application/pdf ; v=1", None, "image/svg+xml"]
SNAPSHOT_ERROR = "timeout of 7000ms exceeded"


def _snapshot_copies(pages: DataFrame) -> DataFrame:
    """The page table as a crawler leaves it: bodies as bytes in three charsets, other content types, errors, outdated copies, and one
    url that a fifth of the rows are copies of."""
    kind = F.col("page_id") % 7
    form = F.when(kind < 2, "charset=EUC-JP").when(kind == 2, "charset=shift_jis").otherwise('charset="utf-8"')
    marked = F.replace("html", F.lit('charset="utf-8"'), form)
    page = F.replace(F.when(kind < 3, F.regexp_replace(marked, r"[^\x00-\x7f]", "\u8a9e")).otherwise(marked), F.lit(". "), F.lit(fixed.SENTENCE_END))
    body = F.when(kind < 2, F.encode(page, "EUC-JP")).when(kind == 2, F.encode(page, "Shift_JIS")).otherwise(F.encode(page, "UTF-8"))
    types = F.element_at(F.array(*map(F.lit, SNAPSHOT_TYPES)), (kind + 1).cast("int"))
    text = F.lit("text/html")
    copies = [
        (F.lit(True), F.col("url"), F.col("page_id") * 10 + 5, types, F.when(kind == 5, SNAPSHOT_ERROR), F.when(kind != 5, body)),
        (F.col("page_id") % 3 == 0, F.col("url"), F.col("page_id") * 10, text, F.lit(None), F.lit(b"<body>outdated</body>")),
        (F.col("page_id") % 5 == 0, F.lit(COMMON_URL), F.col("page_id"), text, F.lit(None), body),
    ]
    rows = [
        F.when(there, F.struct(u.alias("url"), n.cast("bigint").alias("taken"), t.alias("content_type"), e.cast("string").alias("error"), b.alias("body")))
        for there, u, n, t, e, b in copies
    ]
    return pages.select(F.explode(F.array_compact(F.array(*rows))).alias("copy")).select("copy.*")


def scrape_snapshot(spark, sf):
    """Lookup in a stored snapshot of raw bodies; one url has a share of all copies and of all bookmarks."""
    path = shared_dir(configure(spark), "snapshot")
    _snapshot_copies(read_table(spark, sf, "pages")).write.parquet(path)
    rows = _bookmarks(spark, sf)
    rows = rows.withColumn("url", F.when(F.col("row_idx") % 4 == 2, F.lit(COMMON_URL)).otherwise(F.col("url")))
    return lookup.add_page_content(rows, spark.read.parquet(path), order="taken").select(*_LOOKUP_COLUMNS)


def method_breakdown(spark, sf):
    return ledger.breakdown(_looked_up(spark, sf, fallback=True))


def method_labels(spark, sf):
    """Labels by text, on contents with and without failure marks."""
    kind = F.col("doc_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit("<p>Failed to scrape content from x</p>\n"), F.col("text")))
        .when(kind == 1, F.concat(F.lit("<p>Content could not be extracted from "), F.col("text"), F.lit("</p>")))
        .when(kind == 2, F.lit(""))
        .otherwise(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>")))
    )
    method = F.when(F.col("doc_id") % 3 == 0, F.lit("browser")).otherwise(F.lit("lightweight"))
    return _documents(spark, sf).select("doc_id", add_method_label(body, method).alias("labelled"))


def notes_full(spark, sf):
    found = _looked_up(spark, sf, fallback=True).drop("page_error", "page_status")
    return flat(notes.make_notes(found, DAY), "row_idx", "success", "method", "route")


# --- ledger ---------------------------------------------------------------------------------------
def run_stats(spark, sf):
    return ledger.run_stats(_events_ledger(spark, sf), interval=INTERVAL)


def failed_first10(spark, sf):
    return ledger.first_failures(_events_ledger(spark, sf))


def checkpoint_marks(spark, sf):
    return ledger.checkpoint_marks(_events_ledger(spark, sf), INTERVAL)


def _first_half(rows: DataFrame) -> DataFrame:
    """Rows in the first half of the table: the ledger of an interrupted run."""
    half = rows.agg((F.count("*") / 2).alias("half")).scalar()
    return rows.where(F.col("row_idx") < half)


def resume_remaining(spark, sf):
    rows = _bookmarks(spark, sf)
    done = _first_half(rows).where("row_idx % 7 <> 2")
    left = ledger.not_processed(rows, done).select("row_idx", "url")
    behind = ledger.after_last(rows, done).select("row_idx", F.lit(True).alias("behind_last"))
    joined = left.join(behind, "row_idx", "left")
    return joined.withColumn("behind_last", F.coalesce("behind_last", F.lit(False)))


def resume_union(spark, sf):
    rows = notes.make_notes(_bookmarks(spark, sf), DAY)
    saved = _first_half(rows).withColumn("batch_id", F.lit(1).cast("bigint"))
    # The rows behind the last save ran twice: the overlap is in both runs.
    again = rows.where("row_idx % 3 = 0").withColumn("batch_id", F.lit(2).cast("bigint"))
    rest = ledger.not_processed(rows, saved).where("row_idx % 3 <> 0").withColumn("batch_id", F.lit(2).cast("bigint"))
    new = again.unionByName(rest)
    return flat(ledger.merge_runs(saved, new), "row_idx", "batch_id")


# --- documents -----------------------------------------------------------------------------------------
def _with_gaps(rows: DataFrame) -> DataFrame:
    """All rows, with positions that leave gaps of several widths."""
    return rows.withColumn("row_idx", F.expr("row_idx * 3 + row_idx div 7 * 100000"))


def split_manifest(spark, sf):
    rows = read_table(configure(spark), sf, "documents").select(F.col("doc_id").alias("row_idx"))
    return enex.manifest(_with_gaps(rows), "documents", DOCUMENTS_PER_PART)


def row_slices(spark, sf):
    rows = read_table(configure(spark), sf, "documents").select(F.col("doc_id").alias("row_idx"), "n_chars")
    kept = order.renumber(_with_gaps(rows), "row_idx", "note_idx")
    return order.slice_rows(kept, 100, 400, "note_idx")


def enex_parts(spark, sf):
    rows = notes.make_notes(_bookmarks(spark, sf), DAY)
    return enex.document_lines(rows, "bookmarks", EXPORT_DATE, PAGES_PER_PART)


AS_OF, AS_OF_PART = 45, 20
BASE_FILES = ["first.enex", "second part.enex", "third", "fourth.enex.enex"]


def notes_as_of(spark, sf):
    """The document that a run writes at a checkpoint: the notes of the rows that are processed by then."""
    rows = notes.make_notes(_with_gaps(_bookmarks(spark, sf)), DAY)
    return enex.document_lines(ledger.notes_as_of(rows, AS_OF), "bookmarks", EXPORT_DATE, AS_OF_PART)


def input_checks(spark, sf):
    """Problems of inputs that cannot be split, one row an input."""
    rows = read_table(configure(spark), sf, "documents").select("doc_id", "source")
    cases = {"all": (rows, 300), "no rows": (rows.where("source = 'none'"), 300), "zero": (rows, 0), "negative": (rows.limit(0), -1)}
    found = [enex.input_problems(table, size).withColumn("input", F.lit(name)) for name, (table, size) in cases.items()]
    return reduce(DataFrame.unionByName, found)


def enex_base_names(spark, sf):
    """Notes by the base name of the export they stand in, however its files are named."""
    rows = notes.make_notes(_bookmarks(spark, sf), DAY).withColumn("file", F.element_at(F.array(*map(F.lit, BASE_FILES)), (F.col("row_idx") % len(BASE_FILES) + 1).cast("int")))
    numbered = rows.select(F.lit(1).alias("part_no"), F.col("file").alias("file_name"), F.col("row_idx").alias("note_idx"), enex.note_xml().alias("line"))
    path = shared_dir(spark, "enex")
    write_parts(numbered, path)
    blocks = note_blocks(spark, path, shared_dir(spark, "splits"))
    return blocks.groupBy("base_name").agg(F.count("*").alias("notes"))


def enex_roundtrip(spark, sf):
    rows = notes.make_notes(_bookmarks(spark, sf), DAY)
    path = shared_dir(spark, "enex")
    write_parts(enex.document_lines(rows, "bookmarks", EXPORT_DATE, PAGES_PER_PART), path)
    return flat(read_enex(spark, path, shared_dir(spark, "splits")), "row_idx")


FOREIGN_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<en-export\n  export-date="20240131T000000Z"\n  application="Other"\n  version="9">\n'
FOREIGN_TAIL = "\n<!-- end -->\n</en-export>\n"
FOREIGN_FILE, FOREIGN_PART = 450, 200


def split_foreign(spark, sf):
    """Notes of another program, with elements this one does not know, split as they stand."""
    rows = read_table(configure(spark), sf, "documents")
    body = F.format_string(
        "<note>\n<title>%s</title><content><![CDATA[<en-note>%s</en-note>]]></content><created>20240101T000000Z</created>"
        "<note-attributes><latitude>1.5</latitude><reminder-order>%d</reminder-order></note-attributes>"
        '<resource><data encoding="base64">%s</data><mime>image/png</mime></resource></note>',
        "source", text.escape_markup(F.col("text")), "doc_id", F.base64(F.col("lang").cast("binary")),
    )
    broken = F.format_string("<note><title>%d <b></title></note>", "doc_id")
    numbered = order.renumber(rows.select("doc_id", F.when(F.col("doc_id") % 97 == 13, broken).otherwise(body).alias("block")), "doc_id", "note_idx")
    path = shared_dir(spark, "foreign")
    write_parts(enex.block_lines(numbered, "foreign", FOREIGN_HEAD, FOREIGN_TAIL.rstrip("\n"), FOREIGN_FILE), path)
    header, footer = read_enclosure(spark, path)
    checked = enex.check_blocks(note_blocks(spark, path, shared_dir(spark, "splits")))
    good = order.renumber(checked.where("reason = ''").select("row_idx", "block"), "row_idx", "note_idx")
    lines = enex.block_lines(good, "foreign", header, footer, FOREIGN_PART).select("part_no", "note_idx", "line", F.lit("").alias("reason"))
    bad = checked.where("reason <> ''").select(F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), "block", "reason")
    return lines.union(bad)


def _marked_documents(spark, sf) -> DataFrame:
    """Document notes, some with characters XML does not allow."""
    index = F.col("doc_id")
    body = (
        F.when(index % 9 == 4, F.concat("text", F.lit("\ufffe")))
        .when(index % 9 == 5, F.concat(F.lit("\x01"), "text"))
        .otherwise(F.col("text"))
    )
    tag = F.when(index % 11 == 7, F.concat("lang", F.lit("\x0b"))).otherwise(F.col("lang"))
    return _documents(spark, sf).select(
        index.alias("row_idx"),
        F.col("source").alias("title"),
        F.lit("https://docs.example.org/").alias("url"),
        F.lit("0").alias("time_added"),
        tag.alias("tags"),
        F.lit("read").alias("status"),
        body.alias("page_content"),
    )


def note_quarantine(spark, sf):
    return notes.checked(notes.make_notes(_marked_documents(spark, sf), DAY)).select("row_idx", "title", "reason")


# --- streaming ----------------------------------------------------------------------------------------------
PREPARED_BUCKETS = 16


def _run_stream(spark, sf, pages: DataFrame | PreparedPages | None = None) -> str:
    """Feed the bookmarks as CSV files to the stream, in two runs; output folder."""
    base = shared_dir(configure(spark), "stream")
    rows = _bookmarks(spark, sf)
    columns = ["title", "url", "time_added", "tags", "status"]
    for run, part in enumerate((rows.where("row_idx % 3 = 0"), rows.where("row_idx % 3 <> 0"))):
        writer = part.select(*columns).write.mode("append")
        writer.options(**CSV_OPTIONS, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(f"{base}/in")
        query = start_intake(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", DAY, pages)
        query.awaitTermination()
    return f"{base}/out"


def csv_bookmarks(spark, sf):
    """Bookmarks written as CSV files, with quotes and line breaks in fields, and read back in file order."""
    index = F.col("row_idx")
    title = F.when(index % 4 == 1, F.concat("title", F.lit(', "quoted"\nsecond line'))).otherwise(F.col("title"))
    rows = _bookmarks(spark, sf).withColumn("title", title)
    path = shared_dir(spark, "csv")
    columns = ["title", "url", "time_added", "tags", "status"]
    ordered = rows.repartitionByRange(5, "row_idx").sortWithinPartitions("row_idx").select(*columns)
    ordered.write.options(**CSV_OPTIONS, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False).csv(path)
    back = read_bookmarks(spark, path, multi_line=True, work_dir=shared_dir(spark, "splits"))
    empty = {c: F.coalesce(c, F.lit("")) for c in columns}
    return back.withColumns(empty).select("row_idx", *columns, F.col("_corrupt_record").isNotNull().alias("corrupt"))


def stream_enriched(spark, sf):
    """Notes of a stream that looks pages up in a prepared table of two versions, with the failures of the pages that are missing."""
    pages = _http_pages(read_table(configure(spark), sf, "pages"))
    outdated = pages.where("page_id % 2 = 0").select((F.col("page_id") - 1_000_000).alias("page_id"), "url", F.lit("<body>outdated</body>").alias("html"))
    path = shared_dir(spark, "prepared")
    for snapshot in (outdated, pages):
        prepared = prepare_pages(spark, path, snapshot, buckets=PREPARED_BUCKETS)
    out = _run_stream(spark, sf, prepared)
    stored = spark.read.parquet(f"{out}/notes").select("row_idx", *flat_columns())
    entries = read_ledger(spark, f"{out}/ledger").select("row_idx", "method", "success", "error")
    return stored.join(entries, "row_idx").drop("row_idx")


def stream_notes(spark, sf):
    out = _run_stream(spark, sf)
    return flat(spark.read.parquet(f"{out}/notes"))


def stream_metrics(spark, sf):
    out = _run_stream(spark, sf)
    return ledger.batch_metrics(read_ledger(spark, f"{out}/ledger"))


def stream_progress(spark, sf):
    """The running counts that the stream itself observed."""
    return read_progress(spark, f"{_run_stream(spark, sf)}/progress")


def _wide(query):
    """The query with its int columns as bigint, the integer type of the tables."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        table = query(spark, sf)
        narrow = {name: F.col(name).cast("bigint") for name, kind in table.dtypes if kind == "int"}
        return table.withColumns(narrow) if narrow else table

    return run


QUERIES = {
    f.__name__: _wide(f)
    for f in (
        bookmark_rows, limit_rows, notes_plain, note_tags, document_notes,
        url_file_class, content_type_route, page_charset, page_decode,
        html_tokens, element_spans, page_stripped_text, content_pick, longest_block, article_text,
        document_paragraphs, page_enml,
        scrape_join, scrape_snapshot, fallback_chain, method_breakdown, method_labels, notes_full,
        run_stats, failed_first10, checkpoint_marks, resume_remaining, resume_union,
        split_manifest, row_slices, enex_parts, notes_as_of, input_checks, enex_base_names, enex_roundtrip, split_foreign, note_quarantine,
        csv_bookmarks, stream_notes, stream_enriched, stream_metrics, stream_progress,
    )
}
