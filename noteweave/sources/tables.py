"""Parquet table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scan by ``key`` when it has fewer splits than the cluster has cores.

    For plain scans only: asking for the partitions of a plan with shuffles would
    run them.  Large inputs have enough splits and pass through unchanged.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
