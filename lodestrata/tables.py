"""Reading the stored relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The relation `name` of a history stored as one Parquet dataset per relation."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
