"""Parquet tables of a data directory, one per name (a file or a directory of part files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Lazily read ``<directory>/<name>.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
