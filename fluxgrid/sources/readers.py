"""Sources besides Parquet: strict JSON lines, CSV with a byte order mark, manifests and files by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a closed schema; a line that doesn't parse fails the read when it is met."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_by_source(spark: SparkSession, path: str, schema: str, wanted: list[str] | None = None) -> DataFrame:
    """JSON lines of files named <source_id>.jsonl under a glob, with source_id from the name.

    ``wanted`` limits them to some sources, of which none may be missing; a file without rows counts as missing.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("source_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))
    if wanted is None:
        return rows
    rows = rows.where(F.col("source_id").isin(wanted))
    missing = sorted(set(wanted) - {r.source_id for r in rows.select("source_id").distinct().collect()})
    if missing:
        raise ValueError(f"no rows of {', '.join(missing)}")
    return rows


def broken_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line of JSON lines that don't parse, for a report instead of a failure."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    parsed = F.from_json("line", schema + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    return lines.where(parsed.getField("_broken").isNotNull())


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV in UTF-8 with a header, all strings; a byte order mark before the first name goes, '' is null."""
    rows = spark.read.option("header", True).option("nullValue", "").option("multiLine", True).csv(path)
    return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))


def read_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The elements of ``items`` of one JSON document, a row each."""
    rows = spark.read.schema(f"items array<struct<{schema}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.explode("items").alias("i")).select("i.*")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256, kind of files; kind is told by their first bytes."""
    rows = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 8))
    kind = F.when(head == "89504E470D0A1A0A", "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("25504446"), "pdf").otherwise("other")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def enabled_sources(manifest: DataFrame) -> DataFrame:
    """Enabled rows of a manifest, once each; a repeated or empty source_id fails."""
    rows = manifest.where("enabled").distinct()
    sound = rows.groupBy("source_id").agg(F.count("*").alias("n"))
    sound = sound.select(F.col("source_id"), F.assert_true((F.col("n") == 1) & (F.trim(F.coalesce("source_id", F.lit(""))) != ""), F.lit("source_id repeated or empty")).alias("ok"))
    return rows.join(sound.where("ok IS NULL").select("source_id"), "source_id", "left_semi")
