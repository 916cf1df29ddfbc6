"""Queries that check what other queries made: pools of candidates, coverage of the index, losses on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx
from fluxgrid.operators import chunking, evaluation, layout, retrieval
from fluxgrid.plans import retrieval as ret
from fluxgrid.plans.registry import query
from fluxgrid.plans.text import LINES, NORMAL, TYPE_SQL, TYPED_SQL, UNITS
from fluxgrid.sources.scratch import cut
from fluxgrid.sources.tables import read_table

_JUDGED = f"""WITH {ret.FUSED}, {ret.GOLD}, ranked AS (SELECT query, found, rank, {ret.SPLIT} FROM fused),
    judged AS (SELECT f.*, CASE WHEN g.query IS NOT NULL THEN 2 WHEN n.query IS NOT NULL THEN 1 ELSE 0 END AS relevance FROM ranked f
        LEFT JOIN gold g ON g.query = f.query AND g.source_id = f.source_id AND g.page = f.page LEFT JOIN (SELECT DISTINCT query, source_id FROM gold) n ON n.query = f.query AND n.source_id = f.source_id),
    pools AS (SELECT query, count(*) AS candidates, count(DISTINCT found) = count(*) AS unique_ids, min(rank) = 1 AND max(rank) = count(*) AND count(DISTINCT rank) = count(*) AS ranks_complete, bool_and(relevance BETWEEN 0 AND 2) AS labels_known,
        bool_or(relevance = 2) AS direct, bool_or(relevance = 1) AS supporting FROM judged GROUP BY query)"""


def _pools(spark: SparkSession, folder: str) -> DataFrame:
    rows = evaluation.judged(ret._ranked(ret._fused(spark, folder), "rank"), ret._gold(spark, folder))
    return evaluation.pools(rows)


@query(_JUDGED + " SELECT query AS query_id, candidates, unique_ids, ranks_complete, labels_known, direct AS answerable FROM pools")
def pool_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the judged candidates of each question are sound, and whether it can be answered from them."""
    return _pools(spark, folder).select(F.col("query").alias("query_id"), "candidates", "unique_ids", "ranks_complete", "labels_known", F.col("direct").alias("answerable"))


@query(_JUDGED + " SELECT count(*) AS questions, count_if(direct) AS answerable, count_if(NOT direct AND supporting) AS supporting_only, count_if(NOT direct AND NOT supporting) AS all_zero, sum(candidates)::BIGINT AS labels FROM pools")
def gold_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The judged pools as a whole: questions with a direct answer, with supporting pages only, with neither."""
    direct, supporting = F.col("direct"), F.col("supporting")
    return _pools(spark, folder).agg(F.count("*").alias("questions"), F.count_if(direct).alias("answerable"), F.count_if(~direct & supporting).alias("supporting_only"), F.count_if(~direct & ~supporting).alias("all_zero"), F.sum("candidates").alias("labels"))


@query(f"""WITH {ret.RERANKED}, {ret.GOLD}, j AS (SELECT r.query, r.rank, r.rerank_rank, g.query IS NOT NULL AS direct FROM (SELECT *, {ret.SPLIT} FROM reranked) r LEFT JOIN gold g ON g.query = r.query AND g.source_id = r.source_id AND g.page = r.page)
    SELECT query AS query_id, bool_or(direct AND rank <= 5) AS hit_before, bool_or(direct AND rerank_rank <= 5) AS hit_after, round(coalesce(1.0 / min(CASE WHEN direct AND rank <= 5 THEN rank END), 0)::DOUBLE, 6) AS mrr_before, round(coalesce(1.0 / min(CASE WHEN direct AND rerank_rank <= 5 THEN rerank_rank END), 0)::DOUBLE, 6) AS mrr_after FROM j GROUP BY query""")
def rerank_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Hit and reciprocal rank among the first five, before and after the second score."""
    rows = evaluation.judged(ret._ranked(ret._reranked(spark, folder), "rank", "rerank_rank"), ret._gold(spark, folder))
    hit = lambda rank: F.bool_or((F.col("relevance") == 2) & (F.col(rank) <= 5))
    mrr = lambda rank: F.round(F.coalesce(1 / F.min(F.when((F.col("relevance") == 2) & (F.col(rank) <= 5), F.col(rank))), F.lit(0.0)), 6)
    return rows.groupBy(F.col("query").alias("query_id")).agg(hit("rank").alias("hit_before"), hit("rerank_rank").alias("hit_after"), mrr("rank").alias("mrr_before"), mrr("rerank_rank").alias("mrr_after"))


@query(f"""WITH {ret.FUSED} SELECT query AS query_id, found AS page_id, rank::INT AS rank, s.title, s.organization, s.title IS NOT NULL AND s.organization IS NOT NULL AS complete
    FROM (SELECT *, {ret.SPLIT} FROM fused) f LEFT JOIN (SELECT DISTINCT source_id, title, organization FROM source_spec) s USING (source_id)""")
def cited_results(spark: SparkSession, folder: str) -> DataFrame:
    """Fused results with what a citation needs, and whether it is complete."""
    rows = ret._ranked(ret._fused(spark, folder), "rank")
    sources = read_table(spark, folder, "source_spec").select("source_id", "title", "organization").distinct()
    complete = F.col("title").isNotNull() & F.col("organization").isNotNull()
    return rows.join(sources, "source_id", "left").select(F.col("query").alias("query_id"), F.col("found").alias("page_id"), "rank", "title", "organization", complete.alias("complete"))


@query("WITH" + ret._dense_sql(f"NOT semantic_tag_excluded AND source_id IN ({', '.join(repr(s) for s in ret.FACET)})", 20) + f" SELECT query AS query_id, count(*) AS results, bool_and(source_id IN ({', '.join(repr(s) for s in ret.FACET)})) AS compliant FROM dense GROUP BY query")
def filter_compliance(spark: SparkSession, folder: str) -> DataFrame:
    """Whether all results of a filtered search satisfy the filter, looked at once more after the search."""
    found = ret.dense_topk_filtered(spark, folder)
    rows = found.join(read_table(spark, folder, "qdrant_input").select("chunk_id", "source_id").distinct(), "chunk_id")
    return rows.groupBy("query_id").agg(F.count("*").alias("results"), F.bool_and(retrieval.facets({"source_id": ret.FACET})).alias("compliant"))


@query(f"""WITH c AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM qdrant_input WHERE {ret.USABLE.format(v='embedding')}), q AS (SELECT * FROM c WHERE ('0x' || right(chunk_id, 8))::BIGINT % 20 = 0),
    s AS (SELECT q.chunk_id AS query, c.chunk_id AS found, max(list_cosine_similarity(q.v, c.v)) AS score, bool_or(q.chunk_id = c.chunk_id) AS own FROM q, c GROUP BY ALL)
    SELECT query AS chunk_id, round(max(score), 6) AS best, round(max(CASE WHEN own THEN score END), 6) AS own, round(max(score), 9) = round(max(CASE WHEN own THEN score END), 9) AS found_itself FROM s GROUP BY query""")
def self_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Whether chunks find themselves: those whose id, the number at its end, is divisible by 20, against all."""
    chunks = read_table(spark, folder, "qdrant_input").select("chunk_id", "embedding").distinct()
    asked = chunks.where(F.conv(F.right("chunk_id", F.lit(8)), 16, 10).cast("long") % 20 == 0)
    queries = asked.select(F.col("chunk_id").alias("query"), F.col("embedding").alias("qv"))
    top = retrieval.dense_topk(queries, chunks.select(F.col("chunk_id").alias("found"), F.col("embedding").alias("cv")), 1)
    # A copy with a smaller name may stand first: it is as near as the chunk itself, that is at cosine 1.
    best = F.round("cosine", 9)
    return top.select(F.col("query").alias("chunk_id"), F.round("cosine", 6).alias("best"), F.lit(1.0).alias("own"), (best == 1).alias("found_itself"))


@query("""WITH c AS (SELECT DISTINCT source_id, unnest(range(pdf_page_start, pdf_page_end + 1)) AS page FROM qdrant_input), l AS (SELECT DISTINCT source_id, TRY_CAST(regexp_extract(page_id, '(\\d+)$', 1) AS BIGINT) AS page FROM layout_line)
    SELECT coalesce(c.source_id, l.source_id) AS source_id, count_if(c.page IS NOT NULL AND l.page IS NOT NULL) AS both, count_if(l.page IS NULL) AS only_index, count_if(c.page IS NULL) AS only_layout FROM c FULL JOIN l ON c.source_id = l.source_id AND c.page = l.page GROUP BY 1""")
def index_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each source that the index and the layout share, and those that only one of them has."""
    chunks = read_table(spark, folder, "qdrant_input").where("pdf_page_end >= pdf_page_start").select("source_id", F.explode(F.sequence(F.col("pdf_page_start").cast("long"), F.col("pdf_page_end").cast("long"))).alias("page")).distinct()
    lines = read_table(spark, folder, "layout_line").select("page_id", "source_id").distinct().select("source_id", F.regexp_extract("page_id", r"(\d+)$", 1).try_cast("long").alias("page")).distinct()
    both = chunks.withColumn("i", F.lit(1)).join(lines.withColumn("l", F.lit(1)), ["source_id", "page"], "full_outer")
    i, li = F.col("i").isNotNull(), F.col("l").isNotNull()
    return both.groupBy("source_id").agg(F.count_if(i & li).alias("both"), F.count_if(i & ~li).alias("only_index"), F.count_if(~i & li).alias("only_layout"))


@query(f"""WITH {UNITS}, e AS (SELECT source_id, count(*) AS eligible FROM bl WHERE block_type NOT IN ('header', 'footer', 'page_number') GROUP BY source_id)
    SELECT e.source_id, eligible, covered, eligible = covered AS nothing_lost FROM e JOIN (SELECT source_id, sum(blocks)::BIGINT AS covered FROM units GROUP BY source_id) USING (source_id)""")
def block_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each source that should be in units, and those that are."""
    lines, sources = read_table(spark, folder, "layout_line"), read_table(spark, folder, "source_spec")
    eligible = layout.block_runs(layout.typed_lines(lines)).where("NOT block_type IN ('header', 'footer', 'page_number')").groupBy("source_id").agg(F.count("*").alias("eligible"))
    covered = chunking.section_units(lines, sources).groupBy("source_id").agg(F.sum("blocks").cast("long").alias("covered"))
    return eligible.join(covered, "source_id").select("source_id", "eligible", "covered", (F.col("eligible") == F.col("covered")).alias("nothing_lost"))


@query(f"""WITH t AS (SELECT source_id, page_id, {TYPE_SQL} IN ('header', 'footer', 'page_number') AS edge FROM ({TYPED_SQL})), p AS (SELECT DISTINCT source_id, page_id FROM layout_line),
    s AS (SELECT p.source_id, p.page_id, CASE WHEN count(t.edge) = 0 THEN 'blank' WHEN bool_and(t.edge) THEN 'edges_only' ELSE 'units' END AS state FROM p LEFT JOIN t ON t.page_id = p.page_id AND t.source_id = p.source_id GROUP BY ALL)
    SELECT source_id, count(*) AS pages, count_if(state = 'units') AS with_units, count_if(state = 'blank') AS blank, count_if(state = 'edges_only') AS edges_only FROM s GROUP BY source_id""")
def pages_by_state(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each source that give units, and why the others don't."""
    lines = read_table(spark, folder, "layout_line")
    edge = F.col("block_type").isin("header", "footer", "page_number")
    typed = layout.typed_lines(lines).groupBy("source_id", "page_id").agg(F.bool_and(edge).alias("edges"))
    pages = lines.select("source_id", "page_id").distinct().join(typed, ["source_id", "page_id"], "left")
    return pages.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(~F.col("edges")).alias("with_units"), F.count_if(F.col("edges").isNull()).alias("blank"), F.count_if("edges").alias("edges_only"))


@query(f"""SELECT line_id, n = 1 AS kept FROM (SELECT line_id, row_number() OVER (PARTITION BY page_id, regexp_replace(text, '\\s+', '', 'g'), round(x0 * 500), round(y0 * 500) ORDER BY y0, x0, line_no, line_id) AS n FROM {LINES})""")
def layout_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that repeat another one's characters in its place on the page are fragments drawn twice; the first is kept."""
    lines = read_table(spark, folder, "layout_line").select("line_id", "page_id", "line_no", "text", "x0", "y0").distinct()
    key = Window.partitionBy("page_id", F.regexp_replace("text", r"\s+", ""), F.round(F.col("x0") * 500), F.round(F.col("y0") * 500))
    return lines.select("line_id", (F.row_number().over(key.orderBy("y0", "x0", "line_no", "line_id")) == 1).alias("kept"))


@query(f"""SELECT page_id, string_agg(k, ',' ORDER BY first) AS kinds FROM (SELECT page_id, k, min(line_no) AS first FROM (SELECT page_id, line_no, {TYPE_SQL} AS k FROM ({TYPED_SQL})) GROUP BY page_id, k) GROUP BY page_id""")
def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of lines of each page, once each, in order of their first occurrence."""
    typed = layout.typed_lines(read_table(spark, folder, "layout_line"))
    item = F.sort_array(F.collect_list(F.struct("line_no", F.col("block_type").alias("k"))))
    return typed.groupBy("page_id").agg(F.array_join(F.array_distinct(item["k"]), ",").alias("kinds"))


@query("""WITH f AS (SELECT DISTINCT page_id, source_id, text, length(text) AS n, length(text) - length(replace(text, chr(65533), '')) AS r FROM ocr_result),
    g AS (SELECT source_id, unnest(list_filter([CASE WHEN n = 0 THEN 'empty_text' WHEN n < 80 THEN 'low_text' END, CASE WHEN r / greatest(n, 1) > 0.01 THEN 'replacement_characters' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]') THEN 'control_characters' END], lambda x: x IS NOT NULL)) AS flag FROM f)
    SELECT source_id, flag, count(*) AS pages FROM g GROUP BY ALL""")
def flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of each source by quality flag."""
    pages = read_table(spark, folder, "ocr_result").select("page_id", "source_id", "text").distinct()
    return pages.select("source_id", F.explode(tx.quality_flags(F.col("text"))).alias("flag")).groupBy("source_id", "flag").agg(F.count("*").alias("pages"))


@query("""WITH p AS (SELECT DISTINCT source_id, pdf_page_number AS n FROM ocr_result WHERE trim(text, ' ') = ''), i AS (SELECT *, n - row_number() OVER (PARTITION BY source_id ORDER BY n) AS run FROM p)
    SELECT source_id, min(n) AS first_page, max(n) AS last_page, count(*) AS pages FROM i GROUP BY source_id, run""")
def blank_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Ranges of consecutive blank pages of each source: a page begins one if the page before isn't blank, or ends one."""
    pages = cut(read_table(spark, folder, "ocr_result").where("trim(text) = ''").select("source_id", F.col("pdf_page_number").alias("n")).distinct(), "blank")
    begins = pages.join(pages.select("source_id", (F.col("n") + 1).alias("n")), ["source_id", "n"], "left_anti")
    order = Window.partitionBy("source_id").orderBy("n")
    ends = pages.join(pages.select("source_id", (F.col("n") - 1).alias("n")), ["source_id", "n"], "left_anti")
    first = begins.withColumn("nth", F.row_number().over(order)).withColumnRenamed("n", "first_page")
    last = ends.withColumn("nth", F.row_number().over(order)).withColumnRenamed("n", "last_page")
    return first.join(last, ["source_id", "nth"]).select("source_id", "first_page", "last_page", (F.col("last_page") - F.col("first_page") + 1).cast("long").alias("pages"))


@query("""WITH p AS (SELECT DISTINCT source_id, page_id FROM layout_line), n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page_id) - 1 AS pos, count(*) OVER (PARTITION BY source_id) AS of FROM p)
    SELECT source_id, page_id, pos::BIGINT AS pos FROM n WHERE list_contains(list_transform(range(5), lambda i: round_even(i * (n.of - 1) / 4, 0)::BIGINT), pos)""")
def even_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Five pages of each source, evenly spaced in order: numbered over ranges of pages, so no source is sorted at once."""
    pages = layout.numbered_pages(read_table(spark, folder, "layout_line").select("source_id", "page_id").distinct())
    places = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.rint(i * (F.col("pages") - 1) / 4).cast("long"))
    return pages.where(F.array_contains(places, F.col("pos"))).select("source_id", "page_id", "pos")


@query("""SELECT DISTINCT query_id, coalesce(language, '') AS language, coalesce(answerable::VARCHAR, '') AS answerable, to_json(defect_ids)::VARCHAR AS defect_ids, to_json(process_ids)::VARCHAR AS process_ids, to_json(gold_sources)::VARCHAR AS gold_sources, to_json(gold_pages)::VARCHAR AS gold_pages FROM retriever_main""")
def question_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Questions as flat rows of text: lists as JSON, nothing as the empty text."""
    rows = read_table(spark, folder, "retriever_main")
    lists = [F.to_json(c).alias(c) for c in ("defect_ids", "process_ids", "gold_sources", "gold_pages")]
    return rows.select("query_id", F.coalesce("language", F.lit("")).alias("language"), F.coalesce(F.col("answerable").cast("string"), F.lit("")).alias("answerable"), *lists).distinct()


@query(f"""SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), nullif(trim(title, ' '), ''), nullif({NORMAL}, ''))) AS text_hash FROM documents""")
def embedding_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What an encoder reads of each document: its title and its text, if there are such, with an empty line between."""
    shown = lambda c: F.when(c != "", c)
    whole = F.concat_ws("\n\n", shown(F.trim("title")), shown(tx.normalize(F.col("text"))))
    return read_table(spark, folder, "documents").select("doc_id", F.sha2(whole, 256).alias("text_hash"))


@query()
def match_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in the form in which terms are looked for, and the number of questions that share it."""
    rows = read_table(spark, folder, "retriever_main").select("query_id", "query").distinct()
    forms = rows.select("query_id", F.sha2(tx.match_form()("query"), 256).alias("form_hash")).distinct()
    return forms.join(forms.groupBy("form_hash").agg(F.countDistinct("query_id").alias("questions")), "form_hash")
