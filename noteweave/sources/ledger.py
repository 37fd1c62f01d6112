"""Ledger table of processed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from noteweave.schemas import LEDGER


def read_ledger(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Ledger rows; an absent ledger is empty.

    Reports need all rows, so an unreadable file is an error.  ``tolerant`` is for the resume filter: unreadable files
    count as absent, and a row lost that way is only processed again.
    """
    try:
        return spark.read.schema(LEDGER).option("ignoreCorruptFiles", str(tolerant).lower()).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def append_ledger(rows: DataFrame, path: str, replace: bool = False) -> None:
    """Write the rows of whole batches; writing a batch again replaces it.

    ``replace`` starts a new ledger.
    """
    columns = [rows[name] for name in LEDGER.fieldNames()]
    writer = rows.select(*columns).write.mode("overwrite").partitionBy("batch_id")
    writer.option("partitionOverwriteMode", "static" if replace else "dynamic").parquet(path)
