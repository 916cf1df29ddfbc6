"""Resumable ingestion and keyed state with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluxgrid.sources.scratch import shared_folder


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """New files of a table as a stream, with the schema that its files have now.

    A table may be a folder of parts or one file.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{folder}/{table}.parquet*")


def ingest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is new since the last call to ``path`` and stops; a repeated call appends nothing twice."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, folder: str, table: str, label: str) -> DataFrame:
    """A table taken in as a stream, read back from a shared folder."""
    import uuid

    base = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    ingest(read_stream(spark, folder, table), f"{base}/data", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/data")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """event_type, starts, events, value of tumbling windows; rows later than the watermark are left out of a stream."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select("event_type", F.col("w.start").alias("starts"), "events", "value")


def running_state(stream: DataFrame) -> DataFrame:
    """user_id, events, last_type, version of keyed state kept over micro-batches: a count, the latest event, and updates seen."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, at, last, version = state.get if state.exists else (0, 0, "", 0)
        for batch in batches:
            events += len(batch)
            top = batch.sort_values(["ts", "event_id"]).iloc[-1]
            when = int(pd.Timestamp(top["ts"]).value // 1000)
            if when >= at:
                at, last = when, str(top["event_type"])
        state.update((events, at, last, version + 1))
        yield pd.DataFrame([{"user_id": key[0], "events": events, "last_type": last, "version": version + 1}])

    return stream.groupBy("user_id").applyInPandasWithState(fold, "user_id long, events long, last_type string, version int", "events long, at long, last string, version int", "update", GroupStateTimeout.NoTimeout)
