"""Sinks: partitioned overwrite, upsert with removal of stale rows, merge by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_source(rows: DataFrame, path: str, source: str = "source_id") -> None:
    """One folder per source; only the sources in ``rows`` are replaced, each as a whole."""
    rows.write.partitionBy(source).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_json_lines(rows: DataFrame, path: str, source: str = "source_id") -> None:
    rows.write.partitionBy(source).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def synchronized(old: DataFrame, new: DataFrame, key: str, full: bool) -> DataFrame:
    """What a table holds after an upsert of ``new``: all of it, and of ``old`` what it doesn't replace.

    ``full`` removes stale keys, which ``new`` no longer has; that leaves ``new`` itself.
    """
    return new if full else old.join(new.select(key), key, "left_anti").unionByName(new)


def merge_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    return last.select(*keys, "r.*")
