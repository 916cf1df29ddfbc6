"""Ranked results against graded relevance: recall, reciprocal rank, nDCG, hits, and weights compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gold_pages(questions: DataFrame) -> DataFrame:
    """query, source_id, page, relevance 2 of each gold page of each question, once each."""
    pairs = F.explode(F.arrays_zip(F.col("gold_sources").alias("source_id"), F.col("gold_pages").alias("page")))
    rows = questions.dropDuplicates(["query_id"]).where("answerable").select(F.col("query_id").alias("query"), pairs.alias("g"))
    return rows.select("query", F.col("g.source_id").alias("source_id"), F.col("g.page").alias("page")).where("source_id IS NOT NULL AND page IS NOT NULL").distinct()


def judged(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results (query, found, source_id, page, rank) with relevance: 2 a gold page, 1 another page of a gold source, else 0."""
    pages = gold.select("query", "source_id", "page", F.lit(2).alias("direct")).distinct()
    sources = gold.select("query", "source_id", F.lit(1).alias("near")).distinct()
    out = results.join(pages, ["query", "source_id", "page"], "left").join(sources, ["query", "source_id"], "left")
    return out.withColumn("relevance", F.coalesce("direct", "near", F.lit(0))).drop("direct", "near")


def pools(judgements: DataFrame) -> DataFrame:
    """query, candidates, unique_ids, ranks_complete, labels_known, direct, supporting of the judged candidates of each query.

    Sound pools have each candidate once, the ranks 1 to n, and labels 0 to 2; a null label isn't known.
    """
    n = F.count("*")
    return judgements.groupBy("query").agg(
        n.alias("candidates"), (F.countDistinct("found") == n).alias("unique_ids"), ((F.min("rank") == 1) & (F.max("rank") == n) & (F.countDistinct("rank") == n)).alias("ranks_complete"),
        F.bool_and(F.coalesce(F.col("relevance").between(0, 2), F.lit(False))).alias("labels_known"), F.bool_or(F.col("relevance") == 2).alias("direct"), F.bool_or(F.col("relevance") == 1).alias("supporting"),
    )


def _gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)


def per_query(judgements: DataFrame, gold: DataFrame, by: tuple[str, ...] = ("query",)) -> DataFrame:
    """recall5, mrr10, ndcg10, source_hit5, page_hit5 of each query with gold pages; queries without results have 0.

    The ideal order has all gold pages first, found or not, then the other pages of gold sources that were found.
    """
    sizes = gold.groupBy("query").agg(F.count("*").alias("gold"))
    rows = judgements
    top5, top10 = F.col("rank") <= 5, F.col("rank") <= 10
    scores = rows.groupBy(*by).agg(
        F.sum(F.when(top5 & (F.col("relevance") == 2), 1).otherwise(0)).alias("hits5"),
        F.min(F.when(top10 & (F.col("relevance") == 2), F.col("rank"))).alias("first"),
        F.sum(F.when(top10, _gain(F.col("relevance"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.count_if(F.col("relevance") == 1).alias("near"),
        F.max(F.when(top5 & (F.col("relevance") >= 1), 1).otherwise(0)).alias("source_hit5"),
    )
    grid = sizes if by == ("query",) else sizes.crossJoin(judgements.select(*(c for c in by if c != "query")).distinct())
    out = grid.join(scores, list(by), "left").na.fill(0, ["hits5", "dcg", "near", "source_hit5"])
    places = F.sequence(F.lit(1), F.lit(10))
    ideal = F.transform(places, lambda i: _gain(F.when(i <= F.col("gold"), 2).when(i <= F.col("gold") + F.col("near"), 1).otherwise(0), i))
    out = out.withColumn("best", F.aggregate(ideal, F.lit(0.0), lambda s, x: s + x))
    return out.select(
        *by, "gold", "hits5", F.round(F.col("hits5") / F.col("gold"), 6).alias("recall5"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr10"),
        F.round(F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)), 6).alias("ndcg10"), "source_hit5", F.when(F.col("hits5") > 0, 1).otherwise(0).alias("page_hit5"),
    )


def averages(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro means over queries, and micro recall over all gold pages."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("queries"), F.round(F.avg("recall5"), 6).alias("macro_recall5"), F.round(F.sum("hits5") / F.sum("gold"), 6).alias("micro_recall5"),
        F.round(F.avg("mrr10"), 6).alias("mrr10"), F.round(F.avg("ndcg10"), 6).alias("ndcg10"), F.round(F.avg("source_hit5"), 6).alias("source_hit5"), F.round(F.avg("page_hit5"), 6).alias("page_hit5"),
    )


def best_weight(grid: DataFrame) -> DataFrame:
    """The row of a weight grid with the highest macro recall (to 1e-12), then micro recall, mrr, ndcg, then the lowest weight."""
    most = grid.agg(F.max("macro_recall5").alias("most"))
    near = grid.crossJoin(F.broadcast(most)).where("abs(macro_recall5 - most) < 1e-12").drop("most")
    order = Window.orderBy(F.desc("micro_recall5"), F.desc("mrr10"), F.desc("ndcg10"), "w")
    return near.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
