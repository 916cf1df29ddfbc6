"""Queries that read their tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.plans.registry import query
from fluxgrid.sources.scratch import cut
from fluxgrid.sources.tables import read_table
from fluxgrid.streaming import ingest


@query("SELECT source_id, count(*) AS rows_seen, count(DISTINCT page_id) AS pages FROM ocr_result GROUP BY source_id")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages taken in as a stream of files that can be resumed."""
    rows = ingest.ingested(spark, folder, "ocr_result", "pages")
    return rows.groupBy("source_id").agg(F.count("*").alias("rows_seen"), F.countDistinct("page_id").alias("pages"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS starts, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and day; the same transformation runs on a stream, with late events left out."""
    return ingest.windowed_counts(read_table(spark, folder, "events")).withColumn("starts", F.col("starts").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS events, arg_max(event_type, struct_pack(t := ts, i := event_id)) AS last_type FROM events GROUP BY user_id")
def running_state(spark: SparkSession, folder: str) -> DataFrame:
    """State per user kept over the micro-batches of a stream; the last version of each is what counts."""
    import uuid

    from fluxgrid.sources.scratch import shared_folder

    base = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"
    stream = ingest.running_state(ingest.read_stream(spark, folder, "events").select("user_id", "event_id", "ts", "event_type"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/data/batch={batch}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/data")
    return cut(rows, "state").groupBy("user_id").agg(F.max_by("events", "version").alias("events"), F.max_by("last_type", "version").alias("last_type"))
