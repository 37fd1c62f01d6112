"""Bookmarks to notes, with or without page content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.functions.notes import note_content, note_title
from noteweave.functions.text import enex_time, escape_html, has_illegal_xml, split_tags

DEFAULT_AUTHOR = "noteweave"


def make_notes(bookmarks: DataFrame, day: str, author: str = DEFAULT_AUTHOR) -> DataFrame:
    """One note per bookmark: a projection without UDF, join or shuffle.

    ``bookmarks`` may carry a ``page_content`` column; a missing or empty one
    gives the short link body.  ``day`` is the scrape date to print.  Columns not
    used by the note (row index, status columns) pass through.
    """
    if "page_content" not in bookmarks.columns:
        bookmarks = bookmarks.withColumn("page_content", F.lit(None).cast("string"))
    used = ("title", "url", "time_added", "tags", "status", "page_content", "_corrupt_record")
    extra = [c for c in bookmarks.columns if c not in used]
    url = escape_html(F.coalesce("url", F.lit("")))
    status = escape_html(F.coalesce("status", F.lit("")))
    fields = bookmarks.select(
        *extra,
        note_title(F.col("title"), F.col("url")).alias("title"),
        url.alias("url"),
        status.alias("_status"),
        "page_content",
        enex_time(F.col("time_added")).alias("created"),
        split_tags(F.col("tags")).alias("tag"),
    )
    content = note_content(F.col("title"), F.col("url"), F.col("_status"), F.col("page_content"), F.lit(day))
    attributes = F.struct(
        F.lit(author).alias("author"), F.lit(fixed.NOTE_SOURCE).alias("source"), F.col("url").alias("source_url")
    )
    return fields.select(
        *extra,
        "title",
        content.alias("content"),
        "created",
        F.col("created").alias("updated"),
        attributes.alias("note_attributes"),
        "tag",
    )


def explode_tags(notes: DataFrame, *keep: str) -> DataFrame:
    """One row per note and tag, with the tag's position."""
    return notes.select(*keep, F.posexplode("tag").alias("tag_pos", "tag"))


def checked(notes: DataFrame) -> DataFrame:
    """Adds ``reason``: the fields with characters XML forbids, empty for a writable note."""
    bad = {
        "title": has_illegal_xml(F.col("title")),
        "content": has_illegal_xml(F.col("content")),
        "source_url": has_illegal_xml(F.col("note_attributes.source_url")),
        "tag": F.coalesce(F.exists("tag", has_illegal_xml), F.lit(False)),
    }
    return notes.withColumn("reason", F.concat_ws(",", *[F.when(hit, F.lit(name)) for name, hit in bad.items()]))


def quarantine(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split notes into writable ones and ones with characters XML forbids.

    The second table says which field is at fault.  Both read ``checked``; store that first where notes are costly.
    """
    table = checked(notes)
    return table.where("reason = ''").drop("reason"), table.where("reason <> ''")
