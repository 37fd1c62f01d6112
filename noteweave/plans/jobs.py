"""End-to-end jobs: convert a bookmark export, split an ENEX export."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.operators import enex, ledger, notes, order
from noteweave.operators.lookup import add_page_content, without_pages
from noteweave.session import configure
from noteweave.sources.bookmarks import read_bookmarks
from noteweave.sources.enex import note_blocks, read_enclosure, write_parts
from noteweave.sources.ledger import append_ledger, read_ledger


def convert(
    spark: SparkSession,
    bookmarks_csv: str,
    out: str,
    day: str,
    export_date: str,
    base: str = "bookmarks",
    pages: DataFrame | None = None,
    rendered: DataFrame | None = None,
    limit: int | None = None,
    resume: bool = False,
    notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART,
    author: str = notes.DEFAULT_AUTHOR,
    multi_line: bool = False,
) -> DataFrame:
    """Bookmark CSV to numbered ENEX parts; returns the run statistics.

    Leaves ``notes``, ``ledger``, ``quarantine``, ``failures`` and ``parts`` below ``out``.
    The statistics count all rows of the ledger; the time is that of this run.
    With ``resume`` rows the ledger holds are skipped and all notes, old and
    new, are written once each.  Notes are checked as they are stored, before
    anything reads them twice.
    """
    configure(spark)
    notes_path, ledger_path = f"{out}/notes", f"{out}/ledger"
    began = time.monotonic()
    done = read_ledger(spark, ledger_path, tolerant=True) if resume else None
    batch_id = 0 if done is None else (done.agg(F.max("batch_id")).first()[0] or 0) + 1

    # The limit counts rows of the table, not of what is left to do.
    rows = order.first_rows(read_bookmarks(spark, bookmarks_csv, multi_line, f"{out}/work/splits-{batch_id}"), limit)
    total = rows.count()
    if done is not None:
        rows = ledger.not_processed(rows, done)
    if pages is not None:
        rows = add_page_content(rows, pages, rendered, work_dir=f"{out}/work/first-{batch_id}")
    else:
        rows = without_pages(rows)
    rows = rows.withColumns({"raw_url": F.col("url"), "batch_id": F.lit(batch_id).cast("bigint")})
    new_notes = notes.checked(notes.make_notes(rows, day, author))
    writer = new_notes.write.mode("overwrite").partitionBy("batch_id")
    writer.option("partitionOverwriteMode", "dynamic" if resume else "static").parquet(notes_path)

    stored = spark.read.parquet(notes_path).withColumn("batch_id", F.col("batch_id").cast("bigint"))
    latest = stored.where(F.col("batch_id") == batch_id)
    entries = ledger.to_ledger(latest.withColumnRenamed("raw_url", "url"), batch_id)
    append_ledger(entries, ledger_path, replace=not resume)

    all_notes = ledger.merge_runs(stored.where(F.col("batch_id") < batch_id), latest) if resume else latest
    good = all_notes.where("reason = ''")
    all_notes.where("reason <> ''").select("row_idx", "title", "reason").write.mode("overwrite").parquet(f"{out}/quarantine")
    if good.isEmpty():
        raise ValueError("no valid notes to write")
    write_parts(enex.document_lines(good, base, export_date, notes_per_part), f"{out}/parts")
    entries = read_ledger(spark, ledger_path)
    ledger.first_failures(entries).write.mode("overwrite").parquet(f"{out}/failures")
    return ledger.run_stats(entries, total, seconds=time.monotonic() - began)


def split(
    spark: SparkSession, enex_path: str, out: str, notes_per_part: int = fixed.DEFAULT_NOTES_PER_PART
) -> DataFrame:
    """ENEX files to numbered parts below ``out``; returns the manifest.

    Notes, header and footer are copied as they stand.  A note that is no well-formed XML goes to
    ``out/quarantine`` instead, and ``quarantined`` of the manifest counts those.  Blocks are checked and stored once.
    """
    configure(spark)
    if notes_per_part <= 0:
        raise ValueError(enex.PART_SIZE_PROBLEM)
    header, footer = read_enclosure(spark, enex_path)
    stored = f"{out}/work/blocks"
    checked = enex.check_blocks(note_blocks(spark, enex_path, f"{out}/work/splits"))
    checked.write.mode("overwrite").parquet(stored)
    blocks = spark.read.parquet(stored)
    bad = blocks.where("reason <> ''")
    bad.select("row_idx", "block", "reason").write.mode("overwrite").parquet(f"{out}/quarantine")
    counts = blocks.agg(F.count_if(F.col("reason") == "").alias("good"), F.count_if(F.col("reason") != "").alias("bad"), F.min_by("base_name", "row_idx").alias("base")).first()
    if not counts["good"]:
        raise ValueError("no well-formed notes found")
    # Positions close up over quarantined notes.
    good = order.renumber(blocks.where("reason = ''"), "row_idx", "note_idx", f"{out}/work/index")
    write_parts(enex.block_lines(good, counts["base"], header, footer, notes_per_part), f"{out}/parts")
    return enex.manifest(blocks.where("reason = ''"), counts["base"], notes_per_part).withColumn("quarantined", F.lit(counts["bad"]).cast("bigint"))
