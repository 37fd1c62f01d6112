"""Notes to numbered export documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.functions import fixed
from noteweave.functions.text import escape_html, fill
from noteweave.operators.order import part_name, part_number, renumber

PART_SIZE_PROBLEM, NO_NOTES_PROBLEM = "notes per part must be a positive number", "no notes found"


def _element(name: str, value: Column) -> Column:
    """``<name>value</name>``, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>")), F.lit(""))


def cdata(text: Column) -> Column:
    """CDATA section holding exactly ``text``."""
    return F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def note_xml(author: str = "note_attributes.author") -> Column:
    """One ``<note>`` element.

    Title and source URL are escaped in the note already; the content goes into
    CDATA as it is; tags are escaped here, and stand before the attributes as the
    public DTD orders them.
    """
    tags = F.array_join(
        F.transform(F.coalesce("tag", F.array().cast("array<string>")), lambda t: _element("tag", escape_html(t))), ""
    )
    attributes = F.concat(
        _element("author", escape_html(F.col(author))),
        _element("source", F.col("note_attributes.source")),
        _element("source-url", F.col("note_attributes.source_url")),
    )
    return F.concat(
        F.lit("<note>"),
        _element("title", F.col("title")),
        _element("content", cdata(F.col("content"))),
        _element("created", F.col("created")),
        _element("updated", F.col("updated")),
        tags,
        _element("note-attributes", attributes),
        F.lit("</note>"),
    )


def export_header(
    export_date: str, application: str = fixed.EXPORT_APPLICATION, version: str = fixed.EXPORT_VERSION
) -> Column:
    """Prolog, document type and root start tag."""
    places = {"date": export_date, "application": application, "version": version}
    return fill(fixed.EXPORT_PROLOG + fixed.EXPORT_OPEN, **{k: F.lit(v) for k, v in places.items()})


def document_lines(
    notes: DataFrame,
    base: str,
    export_date: str,
    notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART,
    application: str = fixed.EXPORT_APPLICATION,
    version: str = fixed.EXPORT_VERSION,
    dense: str | None = None,
) -> DataFrame:
    """``part_no, file_name, note_idx, line``: the parts as ordered lines.

    Joined by newlines in ``note_idx`` order, the lines of a part are its whole
    document: the first carries the header, the last the footer.  Parts need a
    dense index; it is computed unless ``dense`` names one.
    """
    if dense is None:
        notes, dense = renumber(notes, "row_idx", "note_idx"), "note_idx"
    last = notes.agg(F.max(dense).alias("last")).scalar()
    index = F.col(dense)
    opens = index % notes_per_part == 0
    closes = (index % notes_per_part == notes_per_part - 1) | (index == last)
    header = F.concat(export_header(export_date, application, version), F.lit("\n"))
    part = part_number(notes_per_part, dense)
    return notes.select(
        part.alias("part_no"),
        part_name(base, part).alias("file_name"),
        index.alias("note_idx"),
        F.concat(
            F.when(opens, header).otherwise(F.lit("")),
            note_xml(),
            F.when(closes, F.lit("\n" + fixed.EXPORT_CLOSE)).otherwise(F.lit("")),
        ).alias("line"),
    )


def block_lines(blocks: DataFrame, base: str, header: str, footer: str, notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART) -> DataFrame:
    """``part_no, file_name, note_idx, line`` of notes as they stand (``note_idx`` is dense).

    Joined by newlines the lines of a part are the header, its blocks and the footer.
    """
    last = blocks.agg(F.max("note_idx").alias("last")).scalar()
    index = F.col("note_idx")
    part = part_number(notes_per_part, "note_idx")
    opens = index % notes_per_part == 0
    closes = (index % notes_per_part == notes_per_part - 1) | (index == last)
    line = F.concat(F.when(opens, F.lit(header)).otherwise(F.lit("")), "block", F.when(closes, F.lit(footer)).otherwise(F.lit("")))
    return blocks.select(part.alias("part_no"), part_name(base, part).alias("file_name"), index.alias("note_idx"), line.alias("line"))


def check_blocks(blocks: DataFrame) -> DataFrame:
    """Adds ``reason``: empty, or why a note is no well-formed XML."""
    parsed = F.from_xml("block", T.StructType([T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"})
    return blocks.withColumn("reason", F.when(parsed["_corrupt_record"].isNotNull(), F.lit("malformed")).otherwise(F.lit("")))


def manifest(notes: DataFrame, base: str, notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART) -> DataFrame:
    """One row per part: file name, row range, notes, running total, totals.

    Positions close up over gaps, so all of it follows from the number of notes.
    """
    size, total = int(notes_per_part), notes.count()
    parts = notes.sparkSession.range(1, -(-total // size) + 1).withColumnRenamed("id", "part_no")
    running = F.least(F.col("part_no") * size, F.lit(total).cast("bigint"))
    first = (F.col("part_no") - 1) * size
    return parts.select(
        "part_no",
        part_name(base, F.col("part_no")).alias("file_name"),
        (running - first).alias("notes"),
        first.alias("first_idx"),
        (running - 1).alias("last_idx"),
        running.alias("running_notes"),
        F.lit(total).cast("bigint").alias("total_notes"),
        F.lit(-(-total // size)).cast("bigint").alias("total_parts"),
    )


def input_problems(notes: DataFrame, notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART) -> DataFrame:
    """One row: ``has_notes, notes_per_part, problem`` (empty if the notes can be split); reads one note at most."""
    found = notes.limit(1).agg(F.count("*").alias("any"))
    problem = F.when(F.lit(notes_per_part) <= 0, F.lit(PART_SIZE_PROBLEM)).when(F.col("any") == 0, F.lit(NO_NOTES_PROBLEM)).otherwise(F.lit(""))
    return found.select((F.col("any") > 0).alias("has_notes"), F.lit(notes_per_part).alias("notes_per_part"), problem.alias("problem"))
