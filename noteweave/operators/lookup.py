"""Page content for bookmarks: file stubs, page lookup, fallback lookup, labels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.functions.charset import decode_body
from noteweave.functions.notes import label_line
from noteweave.functions.text import fill, present
from noteweave.functions.urls import content_type_stub, file_class, file_stub, is_text_type, url_path
from noteweave.operators.content import extract
from noteweave.operators.joins import left_lookup
from noteweave.operators.membership import bloom, might_hold
from noteweave.session import shared_dir
from noteweave.sources.pages import PreparedPages

MISSING_PAGE = "page not in snapshot"


def row_place() -> list[Column]:
    """Where a row of a file scan stands."""
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def as_scan(pages: DataFrame, work_dir: str | None = None) -> DataFrame:
    """``pages`` if its rows have a file and a position there, else the same rows stored in the shared folder."""
    try:
        pages.select(*row_place())
        return pages
    except AnalysisException:
        path = work_dir or shared_dir(pages.sparkSession, "snapshot")
        pages.write.mode("overwrite").parquet(path)
        return pages.sparkSession.read.parquet(path)


def latest_copies(
    urls: DataFrame | None, pages: DataFrame, order: str = "page_id", work_dir: str | None = None, keep: dict[str, Column] | None = None
) -> DataFrame:
    """``url, content_type, error, found, _file, _row`` and ``keep``: every url with the place of its latest page, stored.

    Only narrow columns are read.  The latest copy has the largest ``order`` (null is the least), then the last place.  Copies are reduced
    per task before the shuffle, so one url with a large share of the snapshot reaches its reducer as one row per task; a bitmap of the
    wanted urls keeps the rest of the snapshot out of the shuffle.  Without ``urls`` all urls of the snapshot are wanted.
    """
    spark = pages.sparkSession
    path = work_dir or shared_dir(spark, "copies")
    defaults = {"content_type": F.lit(fixed.TEXT_CONTENT_TYPES[0]), "error": F.lit(None).cast("string")}
    given = {name: F.col(name) if name in pages.columns else value for name, value in defaults.items()} | (keep or {})
    rank = [F.col(order).alias("_order")] if order in pages.columns else []
    if urls is None:
        held = F.col("url").isNotNull()
    else:
        urls.select("url").write.mode("overwrite").parquet(f"{path}/urls")
        wanted = spark.read.parquet(f"{path}/urls")
        held = might_hold(F.xxhash64("url"), *bloom(wanted.select(F.xxhash64("url").alias("hash")), wanted.count()))
    narrow = pages.where(held).select("url", F.struct(*rank, *row_place(), *(value.alias(name) for name, value in given.items())).alias("_copy"))
    latest = narrow.groupBy("url").agg(F.max("_copy").alias("_copy"))
    found = (latest if urls is None else wanted.join(latest, "url", "left")).select(
        "url", *(f"_copy.{name}" for name in given), F.col("_copy").isNotNull().alias("found"), "_copy._file", "_copy._row"
    )
    found.write.mode("overwrite").parquet(f"{path}/latest")
    return spark.read.parquet(f"{path}/latest")


def bodies_of(copies: DataFrame, pages: DataFrame, body: str) -> DataFrame:
    """``copies`` (with ``_file, _row``; a stored table) and the column ``body`` of their rows.

    Bodies leave the scan for those copies alone, and stream past a hash table of places: they are neither sorted nor aggregated,
    and copies of one url do not meet.
    """
    place = [F.col("_file"), F.col("_row")]
    bitmap, bits = bloom(copies.select(F.xxhash64(*place).alias("hash")), copies.count())
    scan = pages.select(*row_place(), body).where(might_hold(F.xxhash64(*place), bitmap, bits))
    return scan.join(copies.hint("shuffle_hash"), ["_file", "_row"])


def as_text(body: str) -> Column:
    return F.col("html") if body == "html" else decode_body(F.col("body"))


def bodies(copies: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, html`` of copies (``url, _file, _row``, a stored table)."""
    body = "html" if "html" in pages.columns else "body"
    return bodies_of(copies, pages, body).select("url", as_text(body).alias("html"))


def prepared_copies(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``url, content_type, error, found`` from a table of prepared pages; the urls move to its buckets."""
    known = table.select("url", "content_type", "error", F.lit(True).alias("found"))
    joined = known.join(urls.select("url").hint("shuffle_hash"), "url", "right")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def prepared_bodies(urls: DataFrame, table: DataFrame) -> DataFrame:
    """``url, html`` of the readable pages of the urls; bodies stay in their bucket's task."""
    body = "html" if "html" in table.columns else "body"
    readable = table.where(F.col("error").isNull() & is_text_type(F.col("content_type"))).select("url", body)
    return readable.join(urls.select("url").hint("shuffle_hash"), "url").select("url", as_text(body).alias("html"))


def first_results(urls: DataFrame, pages: DataFrame | PreparedPages, order: str = "page_id") -> DataFrame:
    """``url, content, status, error, method`` of every distinct url, by page lookup.

    The latest copy is chosen on narrow columns; only pages that are there, without error and of a text type have their body read.  Prepared pages
    hold the latest copies only and are joined in place.
    """
    readable = F.col("found") & F.col("error").isNull() & is_text_type(F.col("content_type"))
    if isinstance(pages, PreparedPages):
        table = pages.table(urls.sparkSession)
        copies = prepared_copies(urls, table)
        pages_read = extract(prepared_bodies(urls, table), "url")
    else:
        pages = as_scan(pages)
        copies = latest_copies(urls, pages, order)
        pages_read = extract(bodies(copies.where(readable).select("url", "_file", "_row"), pages), "url")
    problem = (
        F.when(~F.col("found"), F.lit(MISSING_PAGE))
        .when(F.col("error").isNotNull(), F.col("error"))
        .when(url_path(F.col("url")).isNull(), F.lit("Invalid URL"))
    )
    others = copies.where(~readable).withColumn("error", problem)
    failed = fill(fixed.TEXT_FETCH_FAILED, url=F.col("url"), suffix=F.lit(""), error=F.col("error"))
    others = others.select(
        "url",
        F.when(F.col("error").isNotNull(), failed)
        .otherwise(content_type_stub(F.col("url"), F.col("content_type")))
        .alias("content"),
        F.when(F.col("error").isNotNull(), F.lit("fetch_error")).otherwise(F.lit("ok")).alias("status"),
        "error",
    )
    both = pages_read.select("url", "content", "status", F.lit(None).cast("string").alias("error")).union(others)
    return both.withColumn("method", F.lit("lightweight"))


def succeeded(status: str = "status"):
    return F.col(status).isin("ok", "ok_empty")


def with_fallback(results: DataFrame, rendered: DataFrame, order: str = "page_id") -> DataFrame:
    """Second lookup, for the urls whose first one failed only.

    ``results`` is read twice, so hand in a stored table.
    """
    failing = results.where(~succeeded()).select("url")
    rendered = as_scan(rendered)
    copies = latest_copies(failing, rendered, order).where("found").select("url", "_file", "_row")
    found = extract(bodies(copies, rendered), "url", rendered=True).select(
        "url", F.col("content").alias("_content"), F.col("status").alias("_status")
    )
    joined = results.join(found, "url", "left")
    tried = ~succeeded()
    missing = fill(
        fixed.TEXT_FETCH_FAILED, url=F.col("url"), suffix=F.lit(fixed.RENDERED_SUFFIX), error=F.lit(MISSING_PAGE)
    )
    return joined.select(
        "url",
        F.when(tried, F.coalesce("_content", missing)).otherwise(F.col("content")).alias("content"),
        F.when(tried, F.coalesce("_status", F.lit("fetch_error"))).otherwise(F.col("status")).alias("status"),
        F.when(tried & F.col("_status").isNull(), F.lit(MISSING_PAGE))
        .when(~tried, F.col("error"))
        .alias("error"),
        F.when(tried, F.lit("browser")).otherwise(F.col("method")).alias("method"),
    )


def add_page_content(
    bookmarks: DataFrame,
    pages: DataFrame | PreparedPages,
    rendered: DataFrame | None = None,
    order: str = "page_id",
    work_dir: str | None = None,
) -> DataFrame:
    """Bookmarks plus ``page_content, route, method, page_status, page_error, success``.

    All work happens once per distinct url; the bookmarks meet the results in a
    single left join at the end that salts urls bookmarked very often.  With a
    fallback the first results are stored, because they decide which pages the
    second stage reads.  Every bookmark is kept.
    """
    spark = bookmarks.sparkSession
    urls = bookmarks.where(present(F.col("url")) & file_class("url").isNull()).select("url").distinct()
    results = first_results(urls, pages, order)
    if rendered is not None:
        path = work_dir or shared_dir(spark, "first-results")
        results.write.mode("overwrite").parquet(path)
        results = with_fallback(spark.read.parquet(path), rendered, order)
    results = results.withColumnsRenamed(
        {"content": "_found", "status": "_status", "error": "_error", "method": "_method"}
    )
    joined = left_lookup(bookmarks, results, "url", "row_idx").withColumn("_stub", file_stub("url"))

    no_url = fill(
        fixed.TEXT_FETCH_FAILED, url=F.coalesce("url", F.lit("")), suffix=F.lit(""), error=F.lit("Invalid URL")
    )
    is_stub = F.col("_stub").isNotNull()
    page_status = F.when(is_stub, F.lit("ok")).otherwise(F.coalesce("_status", F.lit("fetch_error")))
    method = (
        F.when(~F.col("success"), F.lit("failed"))
        .when(is_stub, F.lit("lightweight"))
        .otherwise(F.col("_method"))
    )
    return (
        joined.withColumn("page_status", page_status)
        .withColumn("success", succeeded("page_status"))
        .withColumn("method", method)
        .withColumn("route", F.when(is_stub, F.lit("url_stub")).otherwise(F.lit("page")))
        .withColumn(
            "page_content",
            F.concat(F.coalesce("_stub", "_found", no_url), label_line(F.col("method"))),
        )
        .withColumn("page_error", F.when(~is_stub, F.coalesce("_error", F.when(F.col("_status").isNull(), "Invalid URL"))))
        .drop("_stub", "_found", "_status", "_method", "_error")
    )


def without_pages(bookmarks: DataFrame) -> DataFrame:
    """The result columns for a run that looks no pages up."""
    return bookmarks.select(
        "*",
        F.lit("ok").alias("page_status"),
        F.lit(True).alias("success"),
        F.lit("none").alias("method"),
        F.lit("none").alias("route"),
        F.lit(None).cast("string").alias("page_error"),
    )
