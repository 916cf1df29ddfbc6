import numpy as np
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from fluxgrid.operators import retrieval
from fluxgrid.plans import catalog

WORDS = ["paste", "stencil", "the", "in", "druck", "größe", "a7", "锡膏印刷", "回流焊", "印", "12"]


def _tables(spark, folder, pages, questions, width):
    """Lines with equal rows, rows that differ in what isn't text, no text, no page; texts of Chinese characters over line ends; a question with two texts."""
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(WORDS[: len(WORDS) - 1], n)) + rng.choice(["", ",", "印", " X9"])
    lines = [(i, f"s:p{i // 9:04d}" if i // 9 else None, "s", 9 - i % 9, say(rng.integers(0, width)), 0.1) for i in range(9 * pages)]
    lines += lines[5:60] + [(*x[:5], 0.2) for x in lines[30:50]] + [(*x[:5], None) for x in lines[40:60]] + [(10**6 + i, f"s:p{i:04d}", "s", None, None if i % 2 else "回 Paste", None) for i in range(9)]
    lines += [(None, "s:blank", "s", 1, "", None), (None, "s:blank", "s", None, "膏", 0.5)]
    asked = [(f"Q{i:03d}", say(rng.integers(1, 6)) + f" lot{i}") for i in range(questions)] + [("Q000", "印刷 Größe"), ("none", "lot"), ("empty", None), ("Q000", "印刷 Größe")]
    spark.createDataFrame(lines, "line_id long, page_id string, source_id string, line_no int, text string, x0 double").withColumn("source", F.lit("native")).repartition(5).write.parquet(f"{folder}/lines")
    spark.createDataFrame(asked, "query_id string, query string").write.parquet(f"{folder}/asked")
    for old, new in (("lines", "layout_line"), ("asked", "retriever_main")):
        spark.read.parquet(f"{folder}/{old}").toPandas().to_parquet(f"{folder}/{new}.parquet")
    return str(folder)


@pytest.mark.parametrize("sizes", [{}, {"SPAN": 7, "SETS": 6, "PAGES": 5, "SLICE": 16, "CELLS": 50, "SUMS": 4}])
def test_sparse_topk_on_odd_rows(spark, tmp_path, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(retrieval, name, size)
    folder = _tables(spark, tmp_path, 40, 25, 4)
    want = connect(folder).sql(catalog.oracle_sql()["sparse_topk"]).df()
    assert len(want) > 400
    same(catalog.queries()["sparse_topk"](spark, folder).toPandas(), want)


def test_sparse_topk_shuffles_little(spark, tmp_path):
    """Neither the text nor the weights are shuffled, and not once per question."""
    folder = _tables(spark, tmp_path, 2_000, 3_000, 9)
    size = sum((tmp_path / f"{t}.parquet").stat().st_size for t in ("layout_line", "retriever_main"))
    written = lambda: sum(e.totalShuffleWrite() for e in _all(spark._jsc.sc().statusStore().executorList(False)))
    before = written()
    assert catalog.queries()["sparse_topk"](spark, folder).count() > 50_000
    assert written() - before < 8 * size


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]
