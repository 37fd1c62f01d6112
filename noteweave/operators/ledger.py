"""Run ledger: counters, failures, checkpoint marks, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.operators.order import index_blocks, running_totals
from noteweave.session import shared_dir

# Rows (16 bytes each) of a list that may be broadcast.
MAX_BROADCAST_REPEATED = 1_000_000


def to_ledger(results: DataFrame, batch_id: int = 0) -> DataFrame:
    """Ledger rows of processed bookmarks (``operators.lookup`` columns)."""
    return results.select(
        "row_idx",
        "url",
        "method",
        "success",
        F.col("page_error").alias("error"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        F.current_timestamp().alias("processed_at"),
    )


def run_stats(
    ledger: DataFrame,
    total: int | None = None,
    interval: int = fixed.DEFAULT_CHECKPOINT_INTERVAL,
    seconds: float | None = None,
) -> DataFrame:
    """One row of counters and rates; rates are null when nothing was processed.

    ``seconds`` is the measured time of the run.  Without it the time between the first and the last row counts, which
    is zero for a run of a single batch.
    """
    between = F.unix_micros(F.max("processed_at")) / 1e6 - F.unix_micros(F.min("processed_at")) / 1e6
    seconds = between if seconds is None else F.lit(float(seconds))
    counts = ledger.agg(
        F.count("*").alias("processed"),
        F.count_if(~F.col("success")).alias("failed"),
        F.max("row_idx").alias("last_row_idx"),
        seconds.alias("_seconds"),
    )
    done, failed = F.col("processed"), F.col("failed")
    return counts.select(
        done,
        (F.lit(total).cast("bigint") if total is not None else done).alias("total"),
        failed,
        F.coalesce("last_row_idx", F.lit(-1)).cast("bigint").alias("last_row_idx"),
        F.round(F.try_divide(100.0 * (done - failed), done), 1).alias("success_rate"),
        F.round(F.try_divide(done, F.col("_seconds")), 2).alias("rows_per_second"),
        F.round(F.col("_seconds") / 60, 1).alias("elapsed_minutes"),
        F.floor(done / interval).alias("checkpoints"),
    )


def first_failures(ledger: DataFrame, shown: int = fixed.FAILURES_SHOWN) -> DataFrame:
    """The first failures in row order, with how many there are and are not shown."""
    failed = ledger.where(~F.col("success"))
    total = failed.agg(F.count("*").alias("n")).scalar()
    top = failed.orderBy("row_idx").limit(shown).select("row_idx", "url")
    return top.select(
        "row_idx",
        "url",
        F.concat(F.lit("record_"), F.col("row_idx").cast("string")).alias("record_id"),
        total.alias("failures"),
        F.greatest(total - shown, F.lit(0)).cast("bigint").alias("not_shown"),
    )


def checkpoint_marks(ledger: DataFrame, interval: int = fixed.DEFAULT_CHECKPOINT_INTERVAL) -> DataFrame:
    """Counters as of every ``interval`` processed rows, in row order and whatever rows are missing.

    Blocks of the narrow index know how many rows and failures stand before them, so the marks that fall into a block are found inside it.
    """
    blocks = index_blocks(ledger.select("row_idx", (~F.col("success")).alias("bad")), "row_idx", "bad")
    first, last = f"_before div {int(interval)} + 1", f"(_before + size(_at)) div {int(interval)}"
    marks = blocks.where(f"{last} >= {first}").selectExpr("*", f"explode(sequence({first}, {last})) AS mark_no")
    placed = marks.selectExpr("*", f"cast(mark_no * {int(interval)} AS bigint) AS processed", f"cast(mark_no * {int(interval)} - _before AS int) AS _place")
    return placed.selectExpr(
        "mark_no",
        "element_at(_at, _place).at AS last_row_idx",
        "processed",
        "_before_bad + size(filter(slice(_at, 1, _place), e -> e.bad)) AS failed",
    )


def last_of(ledger: DataFrame, count: int) -> Column:
    """Index of the ``count``-th row in row order (of the last row if there are fewer), found inside its block; a scalar."""
    blocks = index_blocks(ledger.select("row_idx"), "row_idx").where(f"_before < {int(count)}")
    place = F.least(F.lit(int(count)) - F.col("_before"), F.size("_at")).cast("int")
    return blocks.agg(F.max(F.expr("_at.at")[place - 1]).alias("last")).scalar()


def notes_as_of(notes: DataFrame, count: int) -> DataFrame:
    """The notes that a run had made when ``count`` rows were processed: a range of the index, which scans can skip by.

    All notes if there are fewer; none for a count of 0.
    """
    return notes.where(F.col("row_idx") <= last_of(notes, count))


def after_last(bookmarks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows behind the last processed one (the limit, if any, comes before this)."""
    last = ledger.agg(F.coalesce(F.max("row_idx"), F.lit(-1)).alias("last")).scalar()
    return bookmarks.where(F.col("row_idx") > last)


def not_processed(bookmarks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows the ledger does not hold, wherever they are."""
    return bookmarks.join(ledger.select("row_idx"), "row_idx", "left_anti")


def merge_runs(saved: DataFrame, new: DataFrame, work_dir: str | None = None) -> DataFrame:
    """Saved and new notes, one per row index; the later batch wins.

    Both inputs carry ``batch_id``, and a batch holds a row index once.  Winners are chosen on the two narrow columns, and only for rows that
    more than one batch holds; notes stream past that list, which is broadcast when its size allows, and are neither sorted nor aggregated.
    """
    both = saved.unionByName(new)
    spark = both.sparkSession
    path = work_dir or shared_dir(spark, "repeated")
    counted = both.groupBy("row_idx").agg(F.count("*").alias("_n"), F.max("batch_id").alias("_last"))
    counted.where("_n > 1").select("row_idx", "_last").write.mode("overwrite").parquet(path)
    repeated = spark.read.parquet(path)
    repeated = F.broadcast(repeated) if repeated.count() <= MAX_BROADCAST_REPEATED else repeated.hint("shuffle_hash")
    kept = both.join(repeated, "row_idx", "left").where("_last IS NULL OR batch_id = _last")
    return kept.select(*both.columns)


def breakdown(results: DataFrame) -> DataFrame:
    """Counts by method and outcome."""
    return results.groupBy("method", "success").agg(F.count("*").alias("n"))


def batch_metrics(ledger: DataFrame) -> DataFrame:
    """Counters per batch, with the running totals over batches."""
    per_batch = ledger.groupBy("batch_id").agg(
        F.count("*").alias("_rows"), F.count_if(~F.col("success")).alias("_bad")
    )
    running = running_totals(per_batch, "batch_id", total_processed=F.col("_rows"), total_failed=F.col("_bad"))
    return running.select(
        "batch_id",
        F.col("_rows").alias("processed"),
        F.col("_bad").alias("failed"),
        "total_processed",
        "total_failed",
    )
