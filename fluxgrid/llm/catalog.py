"""The queries of this subpackage, by problem, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.llm import boilerplate, conversations, mixing, neighbors, packing, quality, scanned, tokens, visual_form
from fluxgrid.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of records whose texts differ and look the same."""
    out = None
    for table, key, text in (("ocr_result", "page_id", "text"), ("retriever_main", "query_id", "query")):
        pairs = visual_form.look_alike_pairs(read_table(spark, folder, table), key, text)
        pairs = pairs.select(F.lit(table).alias("table_name"), "key_a", "key_b")
        out = pairs if out is None else out.unionByName(pairs)
    return out


@_query
def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the two tables in its one consistent form."""
    out = None
    for table, key, text in (("ocr_result", "page_id", "text"), ("retriever_main", "query_id", "query")):
        rows = read_table(spark, folder, table).select(F.lit(table).alias("table_name"), F.col(key).alias("key"), F.col(text).alias("text")).distinct()
        rows = visual_form.with_visual_form(rows, "text", "form").select("table_name", "key", "form").distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


@_query
def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Records in classes of equal look: how many share the text, and how many texts share the look."""
    out = None
    for table, key, text in (("ocr_result", "page_id", "text"), ("retriever_main", "query_id", "query")):
        rows = visual_form.look_alike_classes(read_table(spark, folder, table), key, text)
        rows = rows.groupBy(F.lit(table).alias("table_name"), "key").agg(F.max("copies").alias("copies"), F.max("texts").alias("texts"))
        out = rows if out is None else out.unionByName(rows)
    return out


@_query
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every message of every kept conversation, in order."""
    kept = conversations.rebuild_conversations(read_table(spark, folder, "messages"), read_table(spark, folder, "conversations"))
    return kept.select("conversation_id", "turn", "message_id")


@_query
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are repeated excessively within their source."""
    return boilerplate.boilerplate_lines(read_table(spark, folder, "layout_line")).select("line_id").distinct()


@_query
def p3_clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each page without the boilerplate of its source."""
    return boilerplate.without_boilerplate(read_table(spark, folder, "layout_line"))


@_query
def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of consecutive boilerplate lines of each source, with their weights."""
    return boilerplate.boilerplate_blocks(read_table(spark, folder, "layout_line")).withColumnRenamed("source", "source_id")


@_query
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar chunks of each question vector."""
    near = neighbors.nearest(read_table(spark, folder, "query_vectors"), "query_id", "dense", read_table(spark, folder, "qdrant_input"), "chunk_id", "embedding")
    return near.select(F.col("query").alias("query_id"), F.col("found").alias("chunk_id"))


@_query
def p4_chunk_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar other chunks of every chunk whose id, the number at its end, is divisible by 20."""
    chunks = read_table(spark, folder, "qdrant_input")
    asked = chunks.where(F.conv(F.right("chunk_id", F.lit(8)), 16, 10).cast("long") % 20 == 0)
    near = neighbors.nearest(asked, "chunk_id", "embedding", chunks, "chunk_id", "embedding", k=11).where("query <> found")
    order = Window.partitionBy("query").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return near.select(F.col("query").alias("chunk_id"), F.col("found").alias("neighbor_id"), "rank", F.round("cosine", 6).alias("cosine"))


@_query
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of scanned pages with a fault, one row per kind."""
    return scanned.faults(read_table(spark, folder, "ocr_line"))


@_query
def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned pages as repaired, continuous paragraphs, also across pages."""
    return scanned.flowing_paragraphs(read_table(spark, folder, "ocr_line"))


def _document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.with_tokens(read_table(spark, folder, "documents").select("doc_id", "source", "text"), "text")


@_query
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document or piece for each capacity, and the room it leaves."""
    return packing.pack(_document_sizes(spark, folder), read_table(spark, folder, "pack_capacity"))


@_query
def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and unused space by capacity."""
    capacities = read_table(spark, folder, "pack_capacity")
    return packing.summary(packing.pack(_document_sizes(spark, folder), capacities), capacities)


@_query
def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture with their repeats."""
    return mixing.mix(_document_sizes(spark, folder), read_table(spark, folder, "mix_target"))[0]


@_query
def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target, granted and actual share of each source."""
    return mixing.mix(_document_sizes(spark, folder), read_table(spark, folder, "mix_target"))[1]


@_query
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents most of whose characters stand outside sentences."""
    statistics = quality.text_statistics(read_table(spark, folder, "documents"))
    return quality.not_prose(statistics).select(F.col("key").alias("doc_id"))


@_query
def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of each document's text, their percentiles and z-scores within the language, and the flagged tails."""
    return quality.with_tails(quality.text_statistics(read_table(spark, folder, "documents"))).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from fluxgrid.llm.oracles import ORACLES

    return dict(ORACLES)
