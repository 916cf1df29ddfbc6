"""Queries over the vector index, the page texts and the evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx
from fluxgrid.operators import evaluation, layout, retrieval
from fluxgrid.plans.registry import query
from fluxgrid.sources.scratch import cut
from fluxgrid.sources.tables import read_table

USABLE = "{v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    queries = read_table(spark, folder, "query_vectors").select(F.col("query_id").alias("query"), F.col("dense").alias("qv")).distinct()
    rows = read_table(spark, folder, "qdrant_input").withColumnRenamed("chunk_id", "found").withColumnRenamed("embedding", "cv")
    return queries, rows


def _dense_sql(where: str, k: int) -> str:
    return f"""
    q AS (SELECT DISTINCT query_id AS query, dense::DOUBLE[] AS v FROM query_vectors WHERE {USABLE.format(v='dense')}),
    c AS (SELECT DISTINCT chunk_id AS found, source_id, pdf_page_start AS page, pdf_page_end, embedding::DOUBLE[] AS v FROM qdrant_input WHERE {USABLE.format(v='embedding')} AND {where}),
    s AS (SELECT query, found, source_id, page, pdf_page_end, list_cosine_similarity(q.v, c.v) AS score FROM q, c),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS rank FROM s) WHERE rank <= {k})"""


@query("WITH" + _dense_sql("true", 20) + " SELECT query AS query_id, found AS chunk_id, rank::INT AS rank, round(score, 6) AS score FROM dense")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Exact top 20 chunks of each question vector by cosine."""
    queries, rows = _vectors(spark, folder)
    top = retrieval.dense_topk(queries, rows, 20)
    return top.select(F.col("query").alias("query_id"), F.col("found").alias("chunk_id"), "rank", F.round("cosine", 6).alias("score"))


FACET = ["paste_digest_en_2016", "rework_digest_en_2024", "thermal_digest_de_2021", "rework_manual_zh_2020"]


@query("WITH" + _dense_sql(f"NOT semantic_tag_excluded AND source_id IN ({', '.join(repr(s) for s in FACET)})", 20) + " SELECT query AS query_id, found AS chunk_id, rank::INT AS rank FROM dense")
def dense_topk_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 chunks among those of some sources that aren't excluded from tagging; filtered before, not after."""
    queries, rows = _vectors(spark, folder)
    rows = rows.where(~F.col("semantic_tag_excluded") & retrieval.facets({"source_id": FACET}))
    return retrieval.dense_topk(queries, rows, 20).select(F.col("query").alias("query_id"), F.col("found").alias("chunk_id"), "rank")


@query(f"SELECT source_id, semantic_tag_excluded AS excluded, count(DISTINCT chunk_id) AS chunks FROM qdrant_input WHERE {USABLE.format(v='embedding')} GROUP BY ALL")
def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Usable chunks by the values of the indexed fields."""
    e = F.col("embedding")
    usable = (F.size(e) == 64) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    rows = read_table(spark, folder, "qdrant_input").where(usable)
    return rows.groupBy("source_id", F.col("semantic_tag_excluded").alias("excluded")).agg(F.countDistinct("chunk_id").alias("chunks"))


@query(f"""SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0 THEN 'not_finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero'
    WHEN abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1) > 0.02 THEN 'norm' ELSE 'ok' END AS state FROM (SELECT DISTINCT chunk_id, embedding FROM qdrant_input)""")
def vector_states(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each vector may be indexed as it is, and if not, why."""
    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    state = F.when(e.isNull(), "null").when(F.size(e) != 64, "dimension").when(F.exists(e, lambda x: x.isNull() | F.isnan(x)), "not_finite").when(~F.exists(e, lambda x: x != 0), "zero").when(F.abs(norm - 1) > 0.02, "norm").otherwise("ok")
    return read_table(spark, folder, "qdrant_input").select("chunk_id", "embedding").distinct().select("chunk_id", state.alias("state"))


# Pages are what both channels find: a chunk stands for each page that it covers.
def _page_terms(spark: SparkSession, folder: str) -> DataFrame:
    pages = layout.page_text(read_table(spark, folder, "layout_line"))
    return pages.select(F.col("page_id").alias("found"), tx.terms(F.col("text")).alias("terms"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "retriever_main").dropDuplicates(["query_id"]).withColumnRenamed("query", "text")
    return rows.select(F.col("query_id").alias("query"), tx.terms(F.col("text")).alias("terms"))


TERMS = """list_concat(regexp_extract_all(lower({t}), '[a-z0-9äöüß]+'), CASE WHEN length(regexp_replace({t}, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) >= 2
    THEN list_transform(range(1, length(regexp_replace({t}, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'))), lambda i: substr(regexp_replace({t}, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g'), i, 2)) ELSE [] END)"""
SPARSE = f"""
    pages AS (SELECT page_id AS found, string_agg(text, chr(10) ORDER BY line_no, line_id) AS text FROM (SELECT DISTINCT * FROM layout_line) GROUP BY page_id),
    pt AS (SELECT found, unnest({TERMS.format(t='text')}) AS term FROM pages),
    tf AS (SELECT found, term, count(*) AS tf FROM pt GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    post AS (SELECT found, tf.term, tf * ln((SELECT count(*) FROM pages) / df) AS weight FROM tf JOIN df USING (term) WHERE df < (SELECT count(*) FROM pages)),
    qt AS (SELECT DISTINCT query, unnest({TERMS.format(t='text')}) AS term FROM (SELECT DISTINCT query_id AS query, query AS text FROM retriever_main)),
    sp AS (SELECT query, found, round(sum(weight), 6) AS score FROM qt JOIN post USING (term) GROUP BY ALL),
    sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS rank FROM sp) WHERE rank <= 20)"""


def _sparse(spark: SparkSession, folder: str, asked: DataFrame | None = None) -> DataFrame:
    questions = read_table(spark, folder, "retriever_main").select(F.col("query_id").alias("query"), F.col("query").alias("text")).distinct()
    if asked is not None:
        questions = questions.join(asked, "query", "left_semi")
    return retrieval.search_pages(questions, read_table(spark, folder, "layout_line"), 20)


@query(f"WITH {SPARSE} SELECT query AS query_id, found AS page_id, rank::INT AS rank FROM sparse")
def sparse_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Top 20 pages of each question by weighted shared terms."""
    return _sparse(spark, folder).select(F.col("query").alias("query_id"), F.col("found").alias("page_id"), "rank")


def _dense_pages(spark: SparkSession, folder: str) -> DataFrame:
    queries, rows = _vectors(spark, folder)
    pages = F.explode(F.sequence("pdf_page_start", "pdf_page_end"))
    rows = rows.where("pdf_page_end >= pdf_page_start").select("source_id", pages.alias("page"), "cv").select(F.concat_ws(":p", "source_id", tx.page_number(F.col("page"))).alias("found"), "cv")
    return retrieval.dense_topk(queries, rows, 20)


def _channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both channels for the questions that have a vector."""
    dense = cut(_dense_pages(spark, folder), "dense")
    return dense, _sparse(spark, folder, dense.select("query").distinct())


DENSE_PAGES = f"""
    q AS (SELECT DISTINCT query_id AS query, dense::DOUBLE[] AS v FROM query_vectors WHERE {USABLE.format(v='dense')}),
    c AS (SELECT DISTINCT source_id || ':p' || format('{{:04d}}', p) AS found, v FROM (SELECT source_id, unnest(range(pdf_page_start, pdf_page_end + 1)) AS p, embedding::DOUBLE[] AS v FROM qdrant_input WHERE {USABLE.format(v='embedding')})),
    s AS (SELECT query, found, max(list_cosine_similarity(q.v, c.v)) AS score FROM q, c GROUP BY ALL),
    dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, found) AS rank FROM s) WHERE rank <= 20)"""
FUSED = f"""{DENSE_PAGES}, {SPARSE},
    b AS (SELECT query, found, d.rank AS dense_rank, p.rank AS sparse_rank, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + p.rank), 0) AS score
        FROM (SELECT * FROM dense) d FULL JOIN (SELECT * FROM sparse WHERE query IN (SELECT query FROM dense)) p USING (query, found)),
    fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score::DOUBLE DESC, least(dense_rank, sparse_rank), found) AS rank FROM b) WHERE rank <= 10)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.fuse(*_channels(spark, folder), 10)


@query(f"WITH {FUSED} SELECT query AS query_id, found AS page_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, rank::INT AS rank, round(score::DOUBLE, 9) AS score FROM fused")
def hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """Dense and sparse results of the questions with a vector, fused by reciprocal ranks."""
    return _fused(spark, folder).select(F.col("query").alias("query_id"), F.col("found").alias("page_id"), "dense_rank", "sparse_rank", "rank", F.round("score", 9).alias("score"))


@query(f"WITH {FUSED} SELECT count_if(dense_rank IS NOT NULL) AS dense, count_if(sparse_rank IS NOT NULL) AS sparse, count_if(dense_rank IS NOT NULL AND sparse_rank IS NOT NULL) AS both, count(*) AS fused FROM b")
def channel_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the channels, of their union and of their intersection."""
    dense, sparse = _channels(spark, folder)
    both = dense.select("query", "found", F.lit(True).alias("d")).join(sparse.select("query", "found", F.lit(True).alias("s")), ["query", "found"], "full_outer")
    return both.agg(F.count("d").alias("dense"), F.count("s").alias("sparse"), F.count_if(F.col("d") & F.col("s")).alias("both"), F.count("*").alias("fused"))


RERANKED = f"""{FUSED},
    pd AS (SELECT found, list_distinct(list(term)) AS terms FROM pt GROUP BY found), qd AS (SELECT query, list(term) AS terms FROM qt GROUP BY query),
    o AS (SELECT f.*, coalesce(round(len(list_intersect(qd.terms, pd.terms)) / nullif(len(qd.terms), 0), 9), 0) AS overlap FROM fused f LEFT JOIN pd USING (found) LEFT JOIN qd USING (query)),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY coalesce(overlap, 0) DESC, rank, found) AS rerank_rank FROM o)"""


def _reranked(spark: SparkSession, folder: str) -> DataFrame:
    fused = cut(_fused(spark, folder), "fused")
    words = _page_terms(spark, folder).join(fused.select("found").distinct(), "found", "left_semi").select("found", F.array_distinct("terms").alias("have"))
    asked = _questions(spark, folder).select("query", F.array_distinct("terms").alias("want"))
    overlap = F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("want", "have")), F.size("want")), F.lit(0.0)), 9)
    scores = fused.select("query", "found").join(words, "found").join(asked, "query").select("query", "found", overlap.alias("overlap"))
    return retrieval.rerank(fused, scores)


@query(f"WITH {RERANKED} SELECT query AS query_id, found AS page_id, rank::INT AS rank, rerank_rank::INT AS rerank_rank, overlap FROM reranked")
def rerank_order(spark: SparkSession, folder: str) -> DataFrame:
    """Fused results in the order of a second score, the share of the question's terms on the page."""
    return _reranked(spark, folder).select(F.col("query").alias("query_id"), F.col("found").alias("page_id"), "rank", "rerank_rank", "overlap")


FINAL = """final AS (SELECT *, row_number() OVER (PARTITION BY query, w ORDER BY round(final_score, 12) DESC, least(rank, rerank_rank), rank, rerank_rank, found) AS final_rank
    FROM (SELECT *, (1 - w) / (60 + rank) + w / (60 + rerank_rank) AS final_score FROM reranked, weights))"""


@query(f"WITH {RERANKED}, weights AS (SELECT 0.73::DOUBLE AS w), {FINAL} SELECT query AS query_id, found AS page_id, final_rank::INT AS final_rank, round(final_score, 9) AS final_score FROM final WHERE final_rank <= 5")
def rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Top 5 after the two rankings are weighed against each other."""
    final = retrieval.rank_fusion(_reranked(spark, folder)).where("final_rank <= 5")
    return final.select(F.col("query").alias("query_id"), F.col("found").alias("page_id"), "final_rank", F.round("final_score", 9).alias("final_score"))


GOLD = """gold AS (SELECT DISTINCT query, s AS source_id, p AS page FROM (SELECT query_id AS query, unnest(gold_sources) AS s, unnest(gold_pages) AS p FROM (SELECT DISTINCT * FROM retriever_main) WHERE answerable) WHERE s IS NOT NULL AND p IS NOT NULL)"""
SCORES = """judged AS (SELECT f.*, CASE WHEN g.query IS NOT NULL THEN 2 WHEN n.query IS NOT NULL THEN 1 ELSE 0 END AS relevance FROM ranked f
        LEFT JOIN gold g ON g.query = f.query AND g.source_id = f.source_id AND g.page = f.page LEFT JOIN (SELECT DISTINCT query, source_id FROM gold) n ON n.query = f.query AND n.source_id = f.source_id),
    agg AS (SELECT query, w, count_if(rank <= 5 AND relevance = 2) AS hits5, min(CASE WHEN rank <= 10 AND relevance = 2 THEN rank END) AS first, sum(CASE WHEN rank <= 10 THEN (pow(2.0, relevance) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
        count_if(relevance = 1) AS near, max(CASE WHEN rank <= 5 AND relevance >= 1 THEN 1 ELSE 0 END) AS source_hit5 FROM judged GROUP BY ALL),
    scores AS (SELECT query, w, gold, coalesce(hits5, 0) AS hits5, round(coalesce(hits5, 0) / gold, 6) AS recall5, round(coalesce(1.0 / first, 0)::DOUBLE, 6) AS mrr10, round(coalesce(dcg / list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i <= gold THEN 3.0 WHEN i <= gold + coalesce(near, 0) THEN 1.0 ELSE 0.0 END / log2(i + 1))), 0), 6) AS ndcg10, coalesce(source_hit5, 0) AS source_hit5, CASE WHEN hits5 > 0 THEN 1 ELSE 0 END AS page_hit5
        FROM (SELECT query, count(*) AS gold FROM gold GROUP BY query) CROSS JOIN (SELECT DISTINCT w FROM weights) LEFT JOIN agg USING (query, w))"""
AVERAGES = "count(*) AS queries, round(avg(recall5), 6) AS macro_recall5, round(sum(hits5) / sum(gold), 6) AS micro_recall5, round(avg(mrr10), 6) AS mrr10, round(avg(ndcg10), 6) AS ndcg10, round(avg(source_hit5), 6) AS source_hit5, round(avg(page_hit5), 6) AS page_hit5"
SPLIT = "split_part(found, ':p', 1) AS source_id, split_part(found, ':p', 2)::INT AS page"


def _ranked(rows: DataFrame, rank: str, *more: str) -> DataFrame:
    parts = F.split("found", ":p")
    return rows.select("query", "found", *more, parts[0].alias("source_id"), parts[1].cast("int").alias("page"), F.col(rank).alias("rank"))


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.gold_pages(read_table(spark, folder, "retriever_main"))


def _per_query(spark: SparkSession, folder: str) -> DataFrame:
    gold = _gold(spark, folder)
    return evaluation.per_query(evaluation.judged(_ranked(_fused(spark, folder), "rank"), gold), gold)


WEIGHT0 = f"WITH {FUSED}, {GOLD}, weights AS (SELECT 0.0::DOUBLE AS w), ranked AS (SELECT query, found, 0.0::DOUBLE AS w, rank, {SPLIT} FROM fused), {SCORES}"


@query(WEIGHT0 + " SELECT query AS query_id, gold, hits5, recall5, mrr10, ndcg10, source_hit5, page_hit5 FROM scores")
def retrieval_metrics_per_query(spark: SparkSession, folder: str) -> DataFrame:
    """Recall, reciprocal rank, nDCG and hits of every question with gold pages."""
    return _per_query(spark, folder).withColumnRenamed("query", "query_id")


@query(WEIGHT0 + f" SELECT {AVERAGES} FROM scores")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Macro and micro averages over all questions with gold pages."""
    return evaluation.averages(_per_query(spark, folder))


@query(f"WITH {FUSED}, {GOLD}, weights AS (SELECT 0.0::DOUBLE AS w), ranked AS (SELECT query, found, 0.0::DOUBLE AS w, rank, {SPLIT} FROM fused), {SCORES} SELECT relevance, count(*) AS results, count(DISTINCT query) AS questions FROM judged WHERE rank <= 5 GROUP BY relevance")
def relevance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Relevance of what stands among the first five."""
    rows = evaluation.judged(_ranked(_fused(spark, folder), "rank"), _gold(spark, folder)).where("rank <= 5")
    return rows.groupBy("relevance").agg(F.count("*").alias("results"), F.countDistinct("query").alias("questions"))


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    gold = _gold(spark, folder)
    weights = spark.range(101).select((F.col("id") / 100).alias("w"))
    rows = cut(_reranked(spark, folder), "reranked").crossJoin(F.broadcast(weights))
    ranked = _ranked(retrieval.rank_fusion(rows, F.col("w")), "final_rank", "w")
    return evaluation.averages(evaluation.per_query(evaluation.judged(ranked, gold), gold, ("query", "w")), ("w",))


GRID = f"WITH {RERANKED}, {GOLD}, weights AS (SELECT i / 100 AS w FROM range(101) t(i)), {FINAL}, ranked AS (SELECT query, found, w, final_rank AS rank, {SPLIT} FROM final), {SCORES}, grid AS (SELECT w, {AVERAGES} FROM scores GROUP BY w)"


@query(GRID + " SELECT * FROM grid")
def fusion_weight_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Averages at every weight from 0 to 1 by hundredths, in one job."""
    return _grid(spark, folder)


@query(GRID + " SELECT * FROM grid WHERE abs(macro_recall5 - (SELECT max(macro_recall5) FROM grid)) < 1e-12 ORDER BY micro_recall5 DESC, mrr10 DESC, ndcg10 DESC, w LIMIT 1")
def fusion_best_weight(spark: SparkSession, folder: str) -> DataFrame:
    """The weight to use."""
    return evaluation.best_weight(_grid(spark, folder))


@query(f"WITH {GOLD}, c AS (SELECT DISTINCT chunk_id, source_id, pdf_page_start, pdf_page_end FROM qdrant_input) SELECT chunk_id, count(DISTINCT query) AS questions FROM c JOIN gold g ON g.source_id = c.source_id AND g.page BETWEEN c.pdf_page_start AND c.pdf_page_end GROUP BY chunk_id")
def page_overlap_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose pages overlap a gold page, by the number of questions.

    A chunk covers few pages: it is spread over them, so that the overlap is an equality and not a range.
    """
    chunks = read_table(spark, folder, "qdrant_input").select("chunk_id", "source_id", "pdf_page_start", "pdf_page_end").distinct().where("pdf_page_end >= pdf_page_start")
    pages = chunks.select("chunk_id", "source_id", F.explode(F.sequence("pdf_page_start", "pdf_page_end")).alias("page"))
    return pages.join(_gold(spark, folder), ["source_id", "page"]).groupBy("chunk_id").agg(F.countDistinct("query").alias("questions"))


@query("""SELECT coalesce(language, 'none') AS language, d AS defect, p AS process, count(DISTINCT query_id) AS questions, count(DISTINCT CASE WHEN answerable THEN query_id END) AS answerable
    FROM (SELECT query_id, language, answerable, unnest(CASE WHEN len(defect_ids) = 0 THEN ['none'] ELSE defect_ids END) AS d, process_ids FROM retriever_main), unnest(process_ids) t(p) GROUP BY ALL""")
def scope_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Questions by language, defect and process; a question counts under each of its values."""
    rows = read_table(spark, folder, "retriever_main").withColumn("defect", F.explode(F.when(F.size("defect_ids") == 0, F.array(F.lit("none"))).otherwise(F.col("defect_ids"))))
    rows = rows.withColumn("process", F.explode("process_ids")).withColumn("language", F.coalesce("language", F.lit("none")))
    return rows.groupBy("language", "defect", "process").agg(F.countDistinct("query_id").alias("questions"), F.countDistinct(F.when(F.col("answerable"), F.col("query_id"))).alias("answerable"))


@query(f"WITH {GOLD} SELECT s.source_id, count(g.page) AS gold_pages, count(DISTINCT g.query) AS questions FROM source_spec s LEFT JOIN gold g USING (source_id) GROUP BY s.source_id")
def source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Gold pages and questions of every source, also of those without any."""
    gold = _gold(spark, folder)
    sources = read_table(spark, folder, "source_spec").select("source_id").distinct()
    return sources.join(gold, "source_id", "left").groupBy("source_id").agg(F.count("page").alias("gold_pages"), F.countDistinct("query").alias("questions"))


@query("""SELECT query_id, sha256(query_id || '|7') AS order_key, row_number() OVER (ORDER BY sha256(query_id || '|7')) AS position FROM (SELECT DISTINCT query_id FROM retriever_main)""")
def blind_order(spark: SparkSession, folder: str) -> DataFrame:
    """Questions in a reproducible order that tells nothing: by a salted hash, numbered over ranges of it."""
    rows = read_table(spark, folder, "retriever_main").select("query_id").distinct().withColumn("order_key", F.sha2(F.concat("query_id", F.lit("|7")), 256)).withColumn("r", F.substring("order_key", 1, 3))
    sizes = rows.groupBy("r").agg(F.count("*").alias("n"))
    base = sizes.select("r", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("r").orderBy("order_key"))).join(base, "r")
    return rows.select("query_id", "order_key", (F.col("base") + F.col("nth")).alias("position"))
