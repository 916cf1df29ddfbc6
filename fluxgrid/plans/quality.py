"""Queries that hold tables against rules, and set operations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import constraints as dq
from fluxgrid.plans.registry import query
from fluxgrid.sources import readers, sinks
from fluxgrid.sources.tables import read_table

RULES = {
    "layout_line": ("line_id", {"box_in_page": "least(x0, y0, x1, y1) >= 0 AND greatest(x0, y0, x1, y1) <= 1", "box_ordered": "x0 <= x1 AND y0 <= y1", "page_of_source": "left(page_id, length(source_id) + 2) = concat(source_id, ':p')", "known_source_kind": "source IN ('native', 'ocr')", "confidence_scale": "confidence IS NULL OR confidence BETWEEN 0 AND 1"}),
    "qdrant_input": ("chunk_id", {"prefix": "left(chunk_id, length(source_id) + 3) = concat(source_id, ':c_')", "page_range": "pdf_page_start <= pdf_page_end"}),
    "retriever_main": ("query_id", {"language_known": "language IN ('en', 'zh', 'de')", "answerable_known": "answerable IS NOT NULL", "text_shown": "length(query) > 0"}),
    "documents": ("doc_id", {"length_right": "n_chars = length(text)", "source_known": "source IS NOT NULL", "text_shown": "length(text) > 0"}),
}
KEYS = {"layout_line": "line_id", "qdrant_input": "chunk_id", "conversations": "conversation_id"}
SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{r}' AS rule, {k}::VARCHAR AS key FROM {t} WHERE NOT coalesce({c}, false)" for t, (k, rules) in RULES.items() for r, c in rules.items())
SQL += "".join(f" UNION ALL SELECT '{t}', 'repeated_key', {k}::VARCHAR FROM {t} GROUP BY {k} HAVING count(*) > 1" for t, k in KEYS.items())
SQL += " UNION ALL SELECT DISTINCT 'mix_target', 'unknown_source_id', source_id FROM mix_target WHERE source_id NOT IN (SELECT source_id FROM source_spec)"
SQL += " UNION ALL SELECT DISTINCT 'query_vectors', 'unknown_query_id', query_id FROM query_vectors WHERE query_id NOT IN (SELECT query_id FROM retriever_main)"


def _violations(spark: SparkSession, folder: str) -> DataFrame:
    parts = [dq.violations(t, read_table(spark, folder, t), F.col(k), {r: F.expr(c) for r, c in rules.items()}) for t, (k, rules) in RULES.items()]
    parts += [dq.repeated(t, read_table(spark, folder, t), [k]) for t, k in KEYS.items()]
    parts.append(dq.orphans("mix_target", read_table(spark, folder, "mix_target"), "source_id", read_table(spark, folder, "source_spec"), "source_id"))
    parts.append(dq.orphans("query_vectors", read_table(spark, folder, "query_vectors"), "query_id", read_table(spark, folder, "retriever_main"), "query_id"))
    return dq.union(parts)


@query(SQL)
def rule_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every row that breaks a rule of its table."""
    return _violations(spark, folder)


@query(f"SELECT table_name, rule, count(*) AS violations FROM ({SQL}) GROUP BY ALL")
def rule_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Violations by rule."""
    return _violations(spark, folder).groupBy("table_name", "rule").agg(F.count("*").alias("violations"))


@query("""SELECT 'both' AS part, count(*) AS n FROM (SELECT DISTINCT page_id FROM ocr_line INTERSECT SELECT DISTINCT page_id FROM layout_line) UNION ALL SELECT 'ocr_only', count(*) FROM (SELECT DISTINCT page_id FROM ocr_result EXCEPT SELECT DISTINCT page_id FROM layout_line)
    UNION ALL SELECT 'layout_only', count(*) FROM (SELECT DISTINCT page_id FROM layout_line EXCEPT SELECT DISTINCT page_id FROM ocr_result) UNION ALL SELECT 'either', count(*) FROM (SELECT page_id FROM layout_line UNION SELECT page_id FROM ocr_result)""")
def page_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Pages known to the layout, to the scans, to both or to either."""
    ids = {t: read_table(spark, folder, t).select("page_id").distinct() for t in ("ocr_line", "ocr_result", "layout_line")}
    sets = {"both": ids["ocr_line"].intersect(ids["layout_line"]), "ocr_only": ids["ocr_result"].subtract(ids["layout_line"]), "layout_only": ids["layout_line"].subtract(ids["ocr_result"]), "either": ids["layout_line"].union(ids["ocr_result"]).distinct()}
    return dq.union([rows.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n") for part, rows in sets.items()])


@query("""WITH o AS (SELECT DISTINCT page_id, line_no, text FROM ocr_line), l AS (SELECT DISTINCT page_id, line_no, text FROM layout_line WHERE source = 'ocr')
    SELECT coalesce(o.page_id, l.page_id) AS page_id, coalesce(o.line_no, l.line_no) AS line_no, CASE WHEN l.page_id IS NULL THEN 'missing' WHEN o.page_id IS NULL THEN 'stale' ELSE 'changed' END AS state FROM o FULL JOIN l ON o.page_id = l.page_id AND o.line_no = l.line_no WHERE o.text IS DISTINCT FROM l.text""")
def readback(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned lines that the layout doesn't carry as they are: missing, stale or changed."""
    o = read_table(spark, folder, "ocr_line").select("page_id", "line_no", F.col("text").alias("expected"), F.lit(True).alias("e")).distinct()
    a = read_table(spark, folder, "layout_line").where("source = 'ocr'").select("page_id", "line_no", F.col("text").alias("actual"), F.lit(True).alias("a")).distinct()
    rows = o.join(a, ["page_id", "line_no"], "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))
    return rows.select("page_id", "line_no", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "stale").otherwise("changed").alias("state"))


@query("SELECT page_id, source_id, text, processed_at FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY processed_at DESC, text) AS n FROM ocr_result) WHERE n = 1")
def latest_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The last reading of every scanned page."""
    rows = read_table(spark, folder, "ocr_result").select("page_id", "source_id", "text", "processed_at")
    return sinks.merge_by_key(rows, ["page_id"], "processed_at").select("page_id", "source_id", "text", "processed_at")


@query("""WITH old AS (SELECT DISTINCT page_id, source_id FROM layout_line), new AS (SELECT DISTINCT page_id, source_id FROM ocr_result)
    SELECT page_id, source_id, 'kept' AS state FROM old WHERE page_id NOT IN (SELECT page_id FROM new) UNION ALL SELECT page_id, source_id, 'upserted' FROM new""")
def synchronized_pages(spark: SparkSession, folder: str) -> DataFrame:
    """What an index of pages holds after the scanned ones are upserted into it."""
    page = lambda t, state: read_table(spark, folder, t).select("page_id", "source_id").distinct().withColumn("state", F.lit(state))
    return sinks.synchronized(page("layout_line", "kept"), page("ocr_result", "upserted"), "page_id", full=False)


@query("""SELECT s.source_id, s.document_type, s.language, count(DISTINCT l.page_id) AS pages FROM (SELECT DISTINCT * FROM source_spec WHERE enabled) s LEFT JOIN layout_line l USING (source_id) GROUP BY ALL""")
def enabled_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Enabled sources with their pages."""
    pages = read_table(spark, folder, "layout_line").groupBy("source_id").agg(F.countDistinct("page_id").alias("pages"))
    rows = readers.enabled_sources(read_table(spark, folder, "source_spec")).join(pages, "source_id", "left")
    return rows.select("source_id", "document_type", "language", F.coalesce("pages", F.lit(0)).alias("pages"))
