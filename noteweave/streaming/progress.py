"""Progress of a stream: counts observed per batch, with running totals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS = "batch_id bigint, processed bigint, failed bigint, total_processed bigint, total_failed bigint"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``batch_id, processed, failed, total_processed, total_failed``: a row per batch; none before the first."""
    try:
        return spark.read.schema(PROGRESS).parquet(path).select("batch_id", "processed", "failed", "total_processed", "total_failed")
    except AnalysisException:
        return spark.createDataFrame([], PROGRESS)


def write_progress(spark: SparkSession, path: str, batch_id: int, counts: dict) -> None:
    """Adds a batch's counts to the totals of the batch before it.

    Only the last row of the batches before is read, never the ledger; a batch run again replaces its own row.
    """
    before = read_progress(spark, path).where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).limit(1).collect()
    totals = [before[0][f"total_{name}"] if before else 0 for name in ("processed", "failed")]
    row = (counts["processed"], counts["failed"], totals[0] + counts["processed"], totals[1] + counts["failed"], batch_id)
    columns = "processed bigint, failed bigint, total_processed bigint, total_failed bigint, batch_id bigint"
    table = spark.createDataFrame([row], columns).coalesce(1)
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
