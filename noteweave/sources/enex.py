"""ENEX documents: scan, header, and the part writer."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions.text import escape_html
from noteweave.operators.order import number_rows
from noteweave.schemas import ENEX_NOTE


def base_name() -> Column:
    """Name of the file of a row without ``.enex``, as written: the scan names files as parts of a URI."""
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, r"^(.*?)(\.enex)?$", 1)


def read_enex(spark: SparkSession, path: str, work_dir: str | None = None) -> DataFrame:
    """Notes of ENEX files with a dense ``row_idx`` in document order.

    The XML reader decodes title and URL; they are escaped again, because notes
    hold them in escaped form.  ``base_name`` is the file name without ``.enex``.
    """
    scan = (
        spark.read.format("xml")
        .schema(ENEX_NOTE)
        .options(rowTag="note", ignoreSurroundingSpaces="false", mode="PERMISSIVE")
        .load(path)
    )
    named = scan.withColumn("base_name", base_name())
    numbered = number_rows(named, "row_idx", work_dir)
    attributes = F.col("note-attributes")
    return numbered.select(
        "row_idx",
        "base_name",
        escape_html(F.col("title")).alias("title"),
        "content",
        "created",
        "updated",
        F.struct(
            attributes["author"].alias("author"),
            attributes["source"].alias("source"),
            escape_html(attributes["source-url"]).alias("source_url"),
        ).alias("note_attributes"),
        "tag",
    )


#: Renames of finished parts at a time.
RENAMES = 16
NOTE_START = r"<note(?=[\s/>])"
NOTE_END = "</note>"


def note_blocks(spark: SparkSession, path: str, work_dir: str | None = None) -> DataFrame:
    """``row_idx, base_name, block``: every note of ENEX files as it stands, in document order.

    The scan cuts the text behind each end tag, so files are read in splits and no element
    of a note is lost.  What follows the last note of a file is no block.
    """
    scan = spark.read.option("lineSep", NOTE_END).text(path)
    found = scan.where(F.regexp_like("value", F.lit(NOTE_START)))
    named = found.select(
        "*", "_metadata", base_name().alias("base_name"), F.regexp_instr("value", F.lit(NOTE_START)).alias("_at")
    )
    numbered = number_rows(named, "row_idx", work_dir)
    return numbered.select(
        "row_idx", "base_name", F.concat(F.substring("value", F.col("_at"), F.length("value")), F.lit(NOTE_END)).alias("block")
    )


def read_enclosure(spark: SparkSession, path: str) -> tuple[str, str]:
    """Text in front of the first note and behind the last one, of the first file in order of name.

    Both are copied to every part as they are, whatever lines and attributes they hold.
    """
    scan = spark.read.option("lineSep", NOTE_END).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    has_note = F.regexp_like("value", F.lit(NOTE_START))
    row = scan.agg(
        F.min_by(F.when(has_note, F.substring("value", F.lit(1), F.regexp_instr("value", F.lit(NOTE_START)) - 1)), F.when(has_note, F.struct("file", "at", "n"))).alias("head"),
        F.min(F.when(has_note, F.col("file"))).alias("file"),
    ).first()
    if row["file"] is None:
        raise ValueError(f"no notes found in {path}")
    last = scan.where(F.col("file") == row["file"]).agg(F.max_by(F.struct("value", has_note.alias("note")), F.struct("at", "n")).alias("tail")).first()["tail"]
    return row["head"], "" if last["note"] else last["value"]


def read_enex_header(spark: SparkSession, path: str) -> dict[str, str]:
    """Root attributes of an export, wherever their lines break."""
    head, _ = read_enclosure(spark, path)
    names = {"export_date": "export-date", "application": "application", "version": "version"}
    root = re.search(r"<en-export\b[^>]*>", head)
    if root is None:
        raise ValueError(f"no <en-export> element in {path}")
    found = {name: re.search(rf"""\s{attribute}\s*=\s*["']([^"']*)["']""", root[0]) for name, attribute in names.items()}
    return {name: match[1] if match else "" for name, match in found.items()}


def write_parts(lines: DataFrame, path: str) -> None:
    """Write every part as one text file of its own name in ``path``, which then holds the parts only.

    A part's lines meet in one task and are streamed out in order, never held
    together; a part has a bounded number of notes.  Files are written below a hidden folder under Spark's commit
    protocol and take their names when all are complete, so a lost task or a failed job leaves no half part.
    """
    work = f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    (
        lines.repartition("file_name")
        .sortWithinPartitions("file_name", "note_idx")
        .select(F.col("line").alias("value"), F.col("file_name").alias("part"))
        .write.option("maxRecordsPerFile", 0)
        .partitionBy("part")
        .text(work)
    )
    _publish(lines.sparkSession, work, path)


def _publish(spark: SparkSession, work: str, path: str) -> None:
    """Move ``work``/part=<name>/<file> to ``path``/<name>: renames only, in the file system of the path."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for old in system.listStatus(folder):
        if not old.getPath().getName().startswith(("_", ".")):
            system.delete(old.getPath(), True)

    def move(part) -> None:
        name = unquote(part.getPath().getName().removeprefix("part="))
        for file in system.listStatus(part.getPath()):
            if not system.rename(file.getPath(), files.Path(folder, name)):
                raise OSError(f"{name} could not be moved to {path}")

    parts = [p for p in system.listStatus(files.Path(work)) if p.isDirectory()]
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(move, parts))
    system.delete(files.Path(work), True)
