"""Reading the Parquet tables that every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; Parquet, one file or a folder of parts."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
