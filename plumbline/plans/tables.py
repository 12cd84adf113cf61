"""Reading the tables of a folder, one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns are pruned and filters pushed down by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
