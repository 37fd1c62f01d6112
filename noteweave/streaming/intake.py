"""Incremental intake of bookmark files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteweave.operators.ledger import to_ledger
from noteweave.operators.lookup import add_page_content, without_pages
from noteweave.operators.notes import DEFAULT_AUTHOR, make_notes
from noteweave.sources.bookmarks import csv_reader
from noteweave.sources.ledger import append_ledger
from noteweave.sources.pages import PreparedPages
from noteweave.streaming.progress import write_progress


def bookmark_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Bookmark files as a stream.

    A stream has no global row position, so ``row_idx`` is a hash of the file's
    path and the row's fields; ``count_repeats`` tells equal rows of a file apart.
    """
    rows = csv_reader(spark.readStream).option("maxFilesPerTrigger", files_per_batch).csv(path)
    fields = ("title", "url", "time_added", "tags", "status")
    return rows.withColumn("row_idx", F.xxhash64(F.col("_metadata.file_path"), *fields))


def count_repeats(batch: DataFrame) -> DataFrame:
    """Rows equal in all fields get their own keys: the second, third, ... occurrence is hashed in."""
    nth = F.row_number().over(Window.partitionBy("row_idx").orderBy("row_idx"))
    numbered = batch.withColumn("_nth", nth)
    key = F.when(F.col("_nth") == 1, F.col("row_idx")).otherwise(F.xxhash64("row_idx", "_nth"))
    return numbered.withColumn("row_idx", key).drop("_nth")


def start_intake(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    day: str,
    pages: DataFrame | PreparedPages | None = None,
    rendered: DataFrame | None = None,
    files_per_batch: int = 100,
    author: str = DEFAULT_AUTHOR,
) -> StreamingQuery:
    """Turn new bookmark files into notes and ledger rows, batch by batch.

    Writes ``<out>/notes``, ``<out>/ledger`` and ``<out>/progress``, partitioned by batch.  A
    batch run again overwrites its own partitions, so the output holds every row
    once; the ledger is derived from the stored notes, not computed again.  Counts are
    observed while the ledger is written.  Prepared pages are read in the version that is current when a batch begins.
    Stops when the files present at the start are done.
    """
    notes_path, ledger_path = f"{out}/notes", f"{out}/ledger"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch = count_repeats(batch)
        if pages is not None:
            work = f"{out}/work/batch-{batch_id}"
            rows = add_page_content(batch, pages, rendered, work_dir=work)
        else:
            rows = without_pages(batch)
        rows = rows.withColumns({"raw_url": F.col("url"), "batch_id": F.lit(batch_id).cast("bigint")})
        notes = make_notes(rows, day, author)
        notes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(
            notes_path
        )
        stored = session.read.parquet(notes_path).where(F.col("batch_id") == batch_id)
        seen = Observation(f"batch {batch_id}")
        entries = to_ledger(stored.withColumn("url", F.col("raw_url")), batch_id)
        append_ledger(entries.observe(seen, F.count("*").alias("processed"), F.count_if(~F.col("success")).alias("failed")), ledger_path)
        write_progress(session, f"{out}/progress", batch_id, seen.get)

    return (
        bookmark_stream(spark, source, files_per_batch)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
