"""Data-quality rules: every violation as a row, so that nothing is lost silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(table: str, rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """table_name, rule, key of each row for which a rule, a condition that must hold, is false or null.

    All rules are read in one pass over the table.
    """
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    return rows.select(F.lit(table).alias("table_name"), F.explode(broken).alias("rule"), key.cast("string").alias("key"))


def repeated(table: str, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table_name, rule, key of each key that occurs more than once."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(table).alias("table_name"), F.lit("repeated_key").alias("rule"), F.concat_ws(":", *keys).alias("key"))


def orphans(table: str, rows: DataFrame, column: str, parents: DataFrame, parent: str) -> DataFrame:
    """table_name, rule, key of each value of ``column`` that no parent has."""
    lost = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("key")).distinct().join(parents.select(F.col(parent).alias("key")).distinct(), "key", "left_anti")
    return lost.select(F.lit(table).alias("table_name"), F.lit(f"unknown_{column}").alias("rule"), F.col("key").cast("string").alias("key"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
