"""Operators on small cases with known results."""

import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx
from fluxgrid.operators import chat, chunking, constraints, evaluation, graphs, layout, retrieval, series, tagging
from fluxgrid.sources import readers, scratch, sinks
from fluxgrid.streaming import ingest


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "kept"), [("  回流焊  \r\n\r\n  温度曲线  ", "回流焊\n\n温度曲线"), ("a\x00b\t  c", "ab c"), ("x\n\n\n\ny", "x\n\ny"), ("", ""), (None, None)])
def test_normalize(spark, given, kept):
    assert one(spark, tx.normalize(F.col("t")), t=given) == kept


@pytest.mark.parametrize(
    ("text", "accepted", "level", "reason"),
    [
        ("6.2.2.1 印刷", True, 4, "numbered_heading"), ("Solder Paste Shorts", True, 1, "unnumbered_heading"), ("参数 | 数值", False, None, "table_row"), ("2） 具备条件", False, None, "list_sentence"),
        ("0.4N/mm 以上", False, None, "parameter_expression"), ("Sponsored by", False, None, "generic_label"), ("第三章 印刷", True, 1, "named_heading"), ("ab", False, None, "too_short"),
        ("100 Units of work", False, None, "numeric_noise"), ("This ends here。", False, None, "sentence"), ("3 minutes, then 245°C.", False, None, "parameter_expression"), ("ab 12 34 56", False, None, "numeric_noise"), ("a b c 1 2 3 4", True, 1, "unnumbered_heading"), ("a b c d 1 2 3", True, 1, "unnumbered_heading"), ("x" * 101, False, None, "too_long"),
    ],
)
def test_heading(spark, text, accepted, level, reason):
    assert tuple(one(spark, tx.heading(F.col("t")), t=text)) == (accepted, level, reason)


def test_block_types(spark):
    rows = [("Header", 0.1, 0.02, 0.5, 0.05, 10.0), ("Large Title", 0.1, 0.2, 0.5, 0.25, 20.0), ("Running text here.", 0.1, 0.3, 0.5, 0.33, 10.0), ("a | b", 0.1, 0.4, 0.5, 0.43, 10.0), ("12", 0.5, 0.95, 0.52, 0.97, 10.0), ("- item", 0.1, 0.5, 0.4, 0.52, 10.0), ("Table 3 Limits", 0.1, 0.6, 0.4, 0.62, 10.0)]
    df = spark.createDataFrame(rows, "text string, x0 double, y0 double, x1 double, y1 double, font double")
    got = [r.k for r in df.select(tx.block_type(*(F.col(c) for c in ("text", "x0", "y0", "x1", "y1", "font")), F.lit(10.0)).alias("k")).collect()]
    assert got == ["header", "heading", "paragraph", "table", "page_number", "list_item", "table_caption"]


@pytest.mark.parametrize(("text", "term", "held"), [("short-circuit", "short", True), ("a shortcut.", "short", False), ("发生短路了", "短路", True), ("c++ (x)", "c++", True), ("", "a", False)])
def test_terms_stand_alone(spark, text, term, held):
    assert one(spark, tx.contains_term(F.col("t"), F.col("m")), t=text, m=term) is held
    assert one(spark, tx.holds_term(F.col("t"), term), t=text) is held


def test_overlays(spark):
    assert one(spark, tx.without_overlays(F.col("t")), t="- 100% +page(2/24)") == ""
    assert one(spark, tx.without_overlays(F.col("t")), t="正文 page(2/24) | 100%") == "正文"


@pytest.mark.parametrize(("given", "kept"), [("voids | 5% max", "voids | 5% max"), ("100%", ""), ("a | 100% | b\npage (3/9)\nc", "a | b\nc"), ("", ""), (None, None), ("x 99% page(1/2) |", "x 99%")])
def test_overlays_leave_percentages(spark, given, kept):
    assert one(spark, tx.without_overlays(F.col("t")), t=given) == kept


@pytest.mark.parametrize(("text", "score"), [("a 1 2", 2), ("a 1", 0), ("x\ty", 2), ("10 20 30  z\nplain", 5), ("", 0), ("1 2\n3 4\n5", 4)])
def test_table_likeness(spark, text, score):
    assert one(spark, tx.table_likeness(F.col("t")), t=text) == score


SOURCE = "source_id string, title string"
LAYOUT = "line_id long, page_id string, source_id string, line_no int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, source string, confidence double"


def page_lines(spark, pages, source="s"):
    """Layout lines of pages (number to texts), one below the other and near enough to merge."""
    rows, n = [], 0
    for page, texts in pages.items():
        for i, text in enumerate(texts):
            n += 1
            rows.append((n, f"{source}:p{page:04d}", source, i + 1, text, 0.1, 0.1 + 0.02 * i, 0.9, 0.115 + 0.02 * i, 10.0, "native", 1.0))
    return spark.createDataFrame(rows, LAYOUT)


def test_sections_go_on_over_pages(spark, monkeypatch):
    monkeypatch.setattr(layout, "RANGE", 2)
    pages = {1: ["1 Printing", "text"], 2: ["more text"], 3: ["1.2 Stencil", "text"], 4: ["text"], 5: ["text", "2 Reflow", "text"], 6: ["text"]}
    rows = layout.section_paths(layout.typed_lines(page_lines(spark, pages)), spark.createDataFrame([("s", "Book")], SOURCE)).orderBy("line_id").collect()
    assert [(r.section_no, r.section_path) for r in rows] == [
        (1, "1 Printing"), (1, "1 Printing"), (1, "1 Printing"), (2, "1 Printing > 1.2 Stencil"), (2, "1 Printing > 1.2 Stencil"), (2, "1 Printing > 1.2 Stencil"),
        (2, "1 Printing > 1.2 Stencil"), (3, "2 Reflow"), (3, "2 Reflow"), (3, "2 Reflow"),
    ]


def test_unnumbered_headings_in_a_row_are_one_title(spark):
    lines = page_lines(spark, {1: ["before", "SOLDER PASTE SHORTS", "ROOT CAUSES HERE", "text"]})
    rows = layout.section_paths(layout.typed_lines(lines), spark.createDataFrame([("s", "Book")], SOURCE)).orderBy("line_id").collect()
    assert [(r.section_no, r.section_path) for r in rows] == [(0, "Book")] + [(1, "SOLDER PASTE SHORTS / ROOT CAUSES HERE")] * 3


def test_blocks_of_a_page(spark):
    lines = page_lines(spark, {1: ["a long para-", "graph ends here.", "Next words,", "then 中文，", "more", "- item one", "- item two", "a | b", "c | d", " "]})
    rows = layout.block_runs(layout.typed_lines(lines)).orderBy("block_no").collect()
    assert [(r.block_type, r.lines, r.text) for r in rows] == [
        ("paragraph", 5, "a long paragraph ends here.Next words,then 中文，more"), ("list_item", 1, "- item one"), ("list_item", 1, "- item two"), ("table", 2, "a | b\nc | d"),
    ]


def test_header_fonts_do_not_count(spark):
    rows = [(i, "s:p1", "s", i, f"words {i}", 0.1, y, 0.9, y + 0.01, size, "native", 1.0) for i, (y, size) in enumerate([(0.01, 30.0), (0.03, 30.0), (0.05, 30.0), (0.2, 10.0), (0.4, 10.0), (0.6, 16.0)])]
    kinds = [r.block_type for r in layout.typed_lines(spark.createDataFrame(rows, LAYOUT)).orderBy("line_id").collect()]
    assert kinds == ["header"] * 3 + ["paragraph"] * 2 + ["heading"]


def test_ideal_gain_counts_gold_that_was_not_found(spark):
    gold = spark.createDataFrame([("q", "s", p) for p in range(1, 6)], "query string, source_id string, page int")
    found = spark.createDataFrame([("q", "s:p1", "s", 1, 1)], "query string, found string, source_id string, page int, rank int")
    got = evaluation.per_query(evaluation.judged(found, gold), gold).first()
    assert got.ndcg10 == pytest.approx(1 / sum(1 / math.log2(i + 1) for i in range(1, 6)), abs=1e-6)
    assert (got.recall5, got.mrr10) == (0.2, 1.0)


def test_fingerprint_sees_vectors(spark):
    rows = [("a", [0.5, 1.0, None]), ("b", [float("nan")]), ("c", None), ("d", [])]
    of = lambda r: graphs.fingerprint(spark.createDataFrame(r, "k string, v array<float>").select("k", graphs.exact_text("v").alias("v")), ["k", "v"]).first().fingerprint
    assert of(rows) == of(rows[::-1]) and len({of(rows), of([("a", [0.5, 1.0000001, None]), *rows[1:]]), of([*rows[:2], ("c", []), rows[3]])}) == 3


@pytest.mark.parametrize(("given", "kept"), [("  ＳＭＴ　Straße\n x ", "smt strasse x"), ("①", "1"), ("", ""), (None, None), ("回流焊", "回流焊")])
def test_match_form(spark, given, kept):
    assert one(spark, tx.match_form()(F.col("t")), t=given) == kept
    assert one(spark, tx.match_form(case=False)(F.col("t")), t=given) == ("SMT Straße x" if given and "Ｓ" in given else kept)


def test_pools(spark):
    rows = [("a", "x", 1, 2), ("a", "y", 2, 0), ("b", "x", 1, 1), ("b", "x", 3, 3), ("c", "x", 1, None)]
    got = {r.query: r[1:] for r in evaluation.pools(spark.createDataFrame(rows, "query string, found string, rank int, relevance int")).collect()}
    assert got["a"] == (2, True, True, True, True, False) and got["b"] == (2, False, False, False, False, True) and got["c"][:4] == (1, True, True, False)


def test_quality(spark):
    flags = tx.quality_flags(F.col("t"))
    assert one(spark, F.concat_ws(",", flags), t="") == "empty_text"
    assert one(spark, tx.assessment(flags), t="") == "fail"
    assert one(spark, F.concat_ws(",", flags), t="a\x07" + "�" * 9) == "low_text,replacement_characters,control_characters"


def test_uuid5(spark):
    import uuid

    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    for name in ("a", "chunk:1", "规范"):
        assert one(spark, tx.uuid5(F.col("t"), space.hex), t=name) == str(uuid.uuid5(space, name))


def _pack(sizes, least, target, most):
    groups, current = [], []
    for s in sizes:
        if current and (sum(current) + s > most or (sum(current) >= least and sum(current) + s > target)):
            groups.append(current)
            current = []
        current.append(s)
    groups.append(current)
    if len(groups) > 1 and sum(groups[-1]) < least and sum(groups[-2] + groups[-1]) <= most:
        groups[-2:] = [groups[-2] + groups[-1]]
    return groups


def test_packing_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "s", "\n".join(" ".join(["w"] * int(n)) for n in rng.integers(1, 90, rng.integers(1, 40)))) for i in range(30)]
    got = chunking.pack_units(chunking.document_units(spark.createDataFrame(docs, "doc_id long, source string, text string"))).toPandas()
    for i, _, text in docs:
        sizes = [len(x.split()) for x in text.split("\n")]
        mine = got[got.doc_id == i].sort_values("chunk_no")
        assert mine.n_units.tolist() == [len(g) for g in _pack(sizes, 75, 150, 200)]
        assert mine.tokens.sum() == sum(sizes)


def test_packing_of_nothing(spark):
    rows = spark.createDataFrame([(1, "s", None), (2, "s", " \n ")], "doc_id long, source string, text string")
    assert chunking.pack_units(chunking.document_units(rows)).count() == 0


def test_split_text(spark):
    text = " ".join(f"w{i}" for i in range(21))
    parts = one(spark, chunking.split_text(F.col("t"), 8), t=text)
    assert [p.tokens for p in parts] == [8, 8, 5] and " ".join(p.text for p in parts) == text
    parts = one(spark, chunking.split_text(F.col("t"), 6), t="one two three. Four five six\nseven eight\n\n焊料不足。然后短路！ 好")
    assert [(p.text, p.tokens) for p in parts] == [("one two three. Four five six", 6), ("seven eight", 2), ("焊料不足。", 5), ("然后短路！好", 6)]
    parts = one(spark, chunking.split_text(F.col("t"), 100), t="焊" * 250)
    assert [p.tokens for p in parts] == [100, 100, 50]
    assert one(spark, chunking.split_text(F.col("t")), t=" \n ") == [] and one(spark, chunking.split_text(F.col("t")), t=None) is None


def test_sections_to_chunks(spark):
    pages = {1: ["1 Printing", "some text of it", "2 Reflow", "other text"], 2: ["goes on here", "- entry", "after it"], 3: ["Table 1 Limits", "a | b", "x = 1 + 2 wide"]}
    sources = spark.createDataFrame([("s", "Book")], SOURCE)
    units = chunking.section_units(page_lines(spark, pages), sources)
    got = [(r.page_id, r.kind, r.section_no, r.blocks, r.text) for r in units.orderBy("page_id", "unit_no").collect()]
    assert got == [
        ("s:p0001", "title", 1, 1, "1 Printing"), ("s:p0001", "text", 1, 1, "some text of it"), ("s:p0001", "title", 2, 1, "2 Reflow"), ("s:p0001", "text", 2, 1, "other text"),
        ("s:p0002", "text", 2, 1, "goes on here"), ("s:p0002", "list", 2, 2, "- entry\nafter it"), ("s:p0003", "table", 2, 3, "Table 1 Limits\na | b\nx = 1 + 2 wide"),
    ]
    chunks = chunking.section_chunks(units).orderBy("section_no").collect()
    assert [(r.section_path, r.first_page, r.last_page, r.units, r.oversized) for r in chunks] == [("1 Printing", "s:p0001", "s:p0001", 2, False), ("2 Reflow", "s:p0001", "s:p0003", 5, False)]
    small = chunking.section_chunks(units, 1, 3, 4).collect()
    assert all(r.tokens <= 4 or r.oversized or r.text.startswith(("1 Printing", "2 Reflow")) for r in small) and sum(r.tokens for r in small) == sum(r.tokens for r in chunks)
    assert chunking.section_chunks(chunking.section_units(page_lines(spark, pages).limit(0), sources)).count() == 0


def test_same_row_merge(spark):
    rows = [("p", 1, "left", 0.1, 0.100, 0.2, 0.120, 0.9), ("p", 2, "right", 0.5, 0.102, 0.6, 0.122, 0.7), ("p", 3, "below", 0.1, 0.200, 0.2, 0.220, 1.0), ("p", 3, "below", 0.1, 0.200, 0.2, 0.220, 1.0)]
    got = layout.same_row_merge(spark.createDataFrame(rows, "page_id string, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")).orderBy("row_no").collect()
    assert [(r.text, r.pieces) for r in got] == [("left | right", 2), ("below", 1)]
    assert got[0].confidence == pytest.approx(0.8)


def test_section_paths(spark):
    rows = [(i + 1, "p", "s", i + 1, t, k) for i, (t, k) in enumerate([("intro", "paragraph"), ("2 Printing", "heading"), ("body", "paragraph"), ("2.1 Stencil", "heading"), ("body", "paragraph"), ("3 Reflow", "heading"), ("body", "paragraph")])]
    lines = spark.createDataFrame(rows, "line_id long, page_id string, source_id string, line_no int, text string, block_type string")
    got = layout.section_paths(lines, spark.createDataFrame([("s", "Book")], "source_id string, title string")).orderBy("line_no").collect()
    assert [r.section_path for r in got] == ["Book", "2 Printing", "2 Printing", "2 Printing > 2.1 Stencil", "2 Printing > 2.1 Stencil", "3 Reflow", "3 Reflow"]


def _channel(spark, names):
    return spark.createDataFrame([("q", n, i + 1) for i, n in enumerate(names)], "query string, found string, rank int")


def test_fusion(spark):
    got = retrieval.fuse(_channel(spark, "ab"), _channel(spark, "bc"), 3).orderBy("rank").collect()
    assert [r.found for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 62 + 1 / 61)
    got = retrieval.fuse(_channel(spark, "ab"), _channel(spark, "")).orderBy("rank").collect()
    assert [(r.found, r.sparse_rank) for r in got] == [("a", None), ("b", None)]
    assert [r.found for r in retrieval.fuse(_channel(spark, "b"), _channel(spark, "a")).orderBy("rank").collect()] == ["a", "b"]


@pytest.mark.parametrize(("weight", "order"), [(0.0, "abcde"), (1.0, "edcba")])
def test_rank_fusion_ends(spark, weight, order):
    rows = spark.createDataFrame([("q", n, i + 1, 5 - i) for i, n in enumerate("abcde")], "query string, found string, rank int, rerank_rank int")
    assert "".join(r.found for r in retrieval.rank_fusion(rows, weight).orderBy("final_rank").collect()) == order


def test_dense_topk_against_brute_force(spark):
    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    rows = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(c)] + [("c000", c[0].tolist()), ("null", None), ("short", [1.0]), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8)]
    got = retrieval.dense_topk(spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query string, qv array<float>"), spark.createDataFrame(rows, "found string, cv array<float>"), 5, 8).toPandas()
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T
    for i in range(7):
        assert got[got["query"] == f"q{i}"].sort_values("rank").found.tolist() == [f"c{j:03d}" for j in np.argsort(-cos[i])[:5]]


def test_sparse_topk_keeps_frequent_terms(spark):
    docs = spark.createDataFrame([(f"d{i:02d}", ["all"] + ["paste"] * (i < 5) + ["rare"] * (i == 7)) for i in range(10)], "found string, terms array<string>")
    asked = spark.createDataFrame([("q", ["paste", "rare", "all"]), ("none", ["all"])], "query string, terms array<string>")
    got = retrieval.sparse_topk(asked, retrieval.sparse_weights(docs), 10).orderBy("rank").collect()
    assert [(r.query, r.found) for r in got] == [("q", "d07")] + [("q", f"d{i:02d}") for i in range(5)]
    assert [r.score for r in got] == pytest.approx([math.log(10)] + [math.log(2)] * 5, abs=1e-6)
    assert {r.term for r in retrieval.sparse_weights(docs).collect()} == {"rare", "paste"}


def test_blocks_against_brute_force(spark, monkeypatch):
    """Many blocks and groups give what one gives; ties at the k-th place go to the smaller name."""
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    monkeypatch.setattr(retrieval, "GROUP", 40)
    monkeypatch.setattr(retrieval, "PAGES", 4)
    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(200, 8)).round(1), rng.normal(size=(10, 8))
    c[100:] = c[0]
    rows = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(c)], "found string, cv array<float>")
    asked = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [(None, q[0].tolist()), ("none", None)], "query string, qv array<float>")
    got = retrieval.dense_topk(asked, rows, 7, 8).toPandas()
    c, q = c.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 12)
    for i in range(10):
        assert got[got["query"] == f"q{i}"].sort_values("rank").found.tolist() == [f"c{j:03d}" for j in np.lexsort((np.arange(200), -cos[i]))[:7]]
    assert len(got) == 70
    words = [[str(w) for w in rng.integers(0, 9, rng.integers(0, 6))] for _ in range(30)]
    docs = spark.createDataFrame([(f"d{i:02d}", w) for i, w in enumerate(words)], "found string, terms array<string>")
    asked = spark.createDataFrame([(f"q{i}", [str(i), str((i * 3) % 9), "x"]) for i in range(9)] + [("none", [])], "query string, terms array<string>")
    got = retrieval.sparse_topk(asked, retrieval.sparse_weights(docs), 5).toPandas()
    idf = {t: math.log(30 / sum(t in w for w in words)) for w in words for t in w}
    for i in range(9):
        score = {f"d{j:02d}": round(sum(w.count(t) * idf[t] for t in {str(i), str((i * 3) % 9)} if t in idf), 6) for j, w in enumerate(words)}
        best = sorted((-s, d) for d, s in score.items() if s > 0)[:5]
        assert got[got["query"] == f"q{i}"].sort_values("rank").found.tolist() == [d for _, d in best]
    assert retrieval.sparse_topk(asked.limit(0), retrieval.sparse_weights(docs), 5).count() == 0
    assert retrieval.dense_topk(asked.limit(0).select("query", F.array().cast("array<float>").alias("qv")), rows, 7, 8).count() == 0


def test_metrics(spark):
    gold = spark.createDataFrame([("q", "s", 1)], "query string, source_id string, page int")
    order = [2, 3, 1, 4, 5]
    found = spark.createDataFrame([("q", str(p), "s" if p < 4 else "t", p, i + 1) for i, p in enumerate(order)], "query string, found string, source_id string, page int, rank int")
    got = evaluation.per_query(evaluation.judged(found, gold), gold).first()
    assert (got.recall5, got.mrr10) == (1.0, round(1 / 3, 6))
    dcg = 1 / math.log2(2) + 1 / math.log2(3) + 3 / math.log2(4)
    assert got.ndcg10 == pytest.approx(dcg / (3 + 1 / math.log2(3) + 1 / math.log2(4)), abs=1e-6)


def test_macro_and_micro(spark):
    scores = spark.createDataFrame([("a", 1, 1, 1.0, 1.0, 1.0, 1, 1), ("b", 5, 2, 0.4, 1.0, 1.0, 1, 1)], "query string, gold long, hits5 long, recall5 double, mrr10 double, ndcg10 double, source_hit5 int, page_hit5 int")
    got = evaluation.averages(scores).first()
    assert (got.macro_recall5, got.micro_recall5) == (0.7, 0.5)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (1, None)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 41), 50, 51, 60, 70, None]], "node int")
    got = {r.node: r.component for r in graphs.connected_components(nodes, edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 60: 60, 70: 70}
    assert graphs.connected_components(nodes.limit(0), edges.limit(0)).count() == 0


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "a int, b string")
    a, b = (graphs.fingerprint(r, ["a", "b"]).first() for r in (rows, rows.orderBy(F.desc("a")).repartition(7)))
    assert a == b and a.n_rows == 500
    assert graphs.fingerprint(rows.where("a <> 3"), ["a", "b"]).first().fingerprint != a.fingerprint


def test_series(spark):
    assert one(spark, series.window_index(F.col("v"), 0.0, 2.5), v=2.5) == pytest.approx(100)
    rows = spark.createDataFrame([([1.0, 2.0, 2.0],), ([3.0, 1.0],), ([],)], "z array<double>")
    assert [(r[0], r[1]) for r in rows.select(series.rising(F.col("z")), series.falls(F.col("z"))).collect()] == [(True, 0.0), (False, 4.0), (True, 0.0)]
    points = spark.createDataFrame([("k", 0, 0.0), ("k", 10, 10.0), ("k", 15, 0.0)], "k string, t long, v double")
    got = {r.t: r.value for r in series.resample(points, "k", "t", "v", 5).collect()}
    assert got == {0: 0.0, 5: 5.0, 10: 10.0, 15: 0.0}


def test_resample_like_interp(spark):
    rng = np.random.default_rng(1)
    t = np.unique(rng.integers(0, 1000, 60))
    v = rng.normal(size=len(t))
    got = series.resample(spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(t, v, strict=True)], "k string, t long, v double"), "k", "t", "v", 7).toPandas().sort_values("t")
    assert np.allclose(got.value, np.interp(got.t, t, v))


def test_spline_basis():
    basis = series.spline_basis(np.linspace(0, 1, 33), 9)
    assert np.allclose(basis.sum(axis=1), 1) and (basis >= 0).all()
    assert basis[0, 0] == 1 and basis[-1, -1] == 1


def test_tagging(spark):
    docs = spark.createDataFrame([(1, "x", "a shortcut, no defect"), (2, "Bridging", "after reflow soldering"), (3, "Contents", "short circuit"), (4, None, None)], "key long, title string, text string")
    found = tagging.matches(docs)
    assert {(r.key, r.tag, r.matched_in) for r in found.collect()} == {(2, "short", "title"), (2, "reflow", "text")}
    assert [(r.tags, r.origin) for r in tagging.tags(found).collect()] == [("reflow,short", "mixed")]
    assert {r.tag: r.texts for r in tagging.tag_counts(found).collect()}["placement"] == 0


def test_context_window(spark):
    rows = spark.createDataFrame([(i, f"m{i}", " C " if i % 2 else "c", "user", f"t{i}") for i in range(9)] + [(99, "m", None, "user", "x")], "row_id long, message_id string, conversation_id string, role string, content string")
    assert [r.before for r in chat.context(rows).orderBy("row_id").collect()] == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_violations(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int")
    got = constraints.violations("t", rows, F.col("k"), {"small": F.col("v") < 10}).collect()
    assert {(r.rule, r.key) for r in got} == {("small", "2"), ("small", "3")}


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    assert [r.line.strip() for r in readers.broken_json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()] == ['{"a":']
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        readers.read_json_lines(spark, str(tmp_path / "b.jsonl"), "a int").collect()
    (tmp_path / "c.csv").write_text("﻿id,text\n1,\n2,x\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("1", None), ("2", "x")]
    (tmp_path / "d.json").write_text(json.dumps({"items": [{"q": "a"}, {"q": "b"}]}))
    assert readers.read_items(spark, str(tmp_path / "d.json"), "q string").count() == 2
    (tmp_path / "e.png").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    got = readers.file_hashes(spark, str(tmp_path / "e.png")).first()
    assert (got.kind, got.bytes) == ("png", 9)


def test_manifest(spark):
    rows = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "source_id string, enabled boolean")
    assert [r.source_id for r in readers.enabled_sources(rows).collect()] == ["a"]
    with pytest.raises(Exception, match="repeated or empty"):
        readers.enabled_sources(spark.createDataFrame([("", True)], "source_id string, enabled boolean")).collect()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_by_source(spark.createDataFrame([("a", 1), ("b", 2)], "source_id string, v int"), path)
    sinks.write_by_source(spark.createDataFrame([("b", 3)], "source_id string, v int"), path)
    assert {(r.source_id, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 3)}
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "x"), (2, "x")], [(2, "y"), (3, "y")]))
    assert {tuple(r) for r in sinks.synchronized(old, new, "k", full=False).collect()} == {(1, "x"), (2, "y"), (3, "y")}
    assert sinks.synchronized(old, new, "k", full=True).count() == 2


def test_ingest_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("t.parquet", "out", "state"))
    spark.range(5).write.parquet(source)
    for grown, total in ((0, 5), (0, 5), (3, 8)):
        if grown:
            spark.range(grown).write.mode("append").parquet(source)
        ingest.ingest(ingest.read_stream(spark, str(tmp_path), "t"), out, state)
        assert spark.read.parquet(out).count() == total


def test_cut_reads_back_the_same(spark):
    rows = spark.range(100).withColumn("s", F.concat(F.lit("x"), "id"))
    kept = scratch.cut(rows, "t")
    assert kept.dtypes == rows.dtypes and kept.exceptAll(rows).isEmpty()
    assert spark.conf.get("spark.checkpoint.dir")


def test_softmax(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": 1.0, "c": 0.0},)], "s map<string,double>")
    got = rows.select(series.top_classes(F.col("s"), 2).alias("t")).first().t
    assert [x.label for x in got] == ["a", "b"] and got[0].p == pytest.approx(math.e / (2 * math.e + 1), abs=1e-6)
    assert pd.notna(got[0].p)


def test_nearest_route_brute(spark):
    rng = random.Random(5)
    points = [(i, rng.randrange(3), float(rng.randrange(10)), float(rng.randrange(10)), rng.choice([0.0, 1.0, 5.0, round(rng.uniform(0, 9999), 2)])) for i in range(200)]
    points += [(900, 9, 0.0, 0.0, 1.0), (901, 0, 0.0, 0.0, None)]
    routes = [(i, rng.randrange(3), float(rng.randrange(10)), float(rng.randrange(10)), rng.choice([0.0, 7.0, round(rng.uniform(0, 9999), 2)])) for i in range(60)] + [(60, 0, 0.0, 0.0, None)]
    p = spark.createDataFrame(points, "point int, g int, x double, y double, v double")
    r = spark.createDataFrame(routes, "route int, g int, rx double, ry double, rv double")
    want = {}
    for point, g, x, y, v in points:
        near = [(round(abs(math.log1p(v) - math.log1p(rv)), 9), round(math.hypot(x - rx, y - ry), 6), route) for route, h, rx, ry, rv in routes if h == g and None not in (v, rv)]
        if near:
            want[point] = min(near)[2]
    assert {x.point: x.route for x in series.nearest_route(p, r, "g").collect()} == want
    assert series.nearest_route(p.limit(0), r, "g").count() == 0


def test_context_over_spans(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "A ", "b", None]), rng.choice([None, str(i)])) for i in range(80)]
    got = {r.row_id: (r.before, r.context_hash) for r in chat.context(spark.createDataFrame(rows, "row_id long, conversation_id string, content string")).collect()}
    seen, want = {}, {}
    for i, c, t in rows:
        if c is not None:
            before = seen.setdefault(c.strip().lower(), [])
            want[i] = (len(before[-6:]), hashlib.sha256("\n".join(before[-6:]).encode()).hexdigest())
            before.append(t or "")
    assert got == want


def test_numbered_pages(spark, monkeypatch):
    monkeypatch.setattr(layout, "RANGE", 3)
    rows = [("s", f"s:p{i:04d}") for i in range(11)] + [("t", "t:p0007"), ("t", "odd")]
    got = {r.page_id: (r.pos, r.pages) for r in layout.numbered_pages(spark.createDataFrame(rows, "source_id string, page_id string")).collect()}
    assert got == {f"s:p{i:04d}": (i, 11) for i in range(11)} | {"odd": (0, 2), "t:p0007": (1, 2)}


def test_trace_and_mapped(spark):
    texts = spark.createDataFrame(
        [(1, "placement_bulletin_en_2020", "Wave process audit", "The aperture was worn; bridging followed."), (2, "x", "Contents", "aperture"), (3, None, None, None), (4, "x", "Reflow soldering", "reflow soldering again")],
        "key int, source string, title string, text string",
    )
    sources = spark.createDataFrame([("x", ["b", "a"]), ("x", ["b", "a"]), ("y", None)], "source string, roles array<string>")
    found = tagging.trace(texts, sources)
    got = {(r.key, r.rule, r.process, r.defect, r.role, r.matched_in) for r in found.collect()}
    assert got == {
        (1, "cause-aperture:relation-01", "printing", "insufficient_solder", None, "text"), (1, "section-01", "placement", None, "process_guideline", "section"),
        (4, "process:reflow", "reflow", None, None, "title"), (4, "default:x", None, None, "a", "source"), (4, "default:x", None, None, "b", "source"),
    }
    assert {r.key: tuple(r)[1:] for r in tagging.mapped(texts, found).collect()} == {
        1: (False, "printing,placement", "insufficient_solder", "process_guideline", 2), 2: (True, "", "", "", 0), 3: (False, "", "", "", 0), 4: (False, "reflow", "", "a,b", 3),
    }
    assert tagging.trace(texts.limit(0), sources).count() == 0


def test_article_units(spark):
    lines = [("p:1", t) for t in ["intro", "A", "sub", "body", "7", "more", "A", "x"]] + [("p:2", t) for t in ["go on", "B", "A"]] + [("p:3", " ")]
    lines = [(i, p, "s", i, t) for i, (p, t) in enumerate(lines)]
    frame = spark.createDataFrame(lines + lines[:2], "line_id int, page_id string, source_id string, line_no int, text string")
    marks = spark.createDataFrame([("s", "A", 1, 1), ("s", "B", 1, 1), ("other", "x", 1, 0)], "source_id string, marker string, occurrence int, following int")
    got = sorted(tuple(r)[0:1] + tuple(r)[2:] for r in layout.article_units(frame, marks, [r"\d+"]).collect())
    assert got == [
        ("p:1", 0, 1, "text", 1, "intro"), ("p:1", 1, 2, "title", 2, "A\nsub"), ("p:1", 1, 3, "text", 4, "body\nmore\nA\nx"),
        ("p:2", 1, 1, "text", 1, "go on"), ("p:2", 2, 2, "title", 1, "B"), ("p:2", 3, 3, "title", 1, "A"),
    ]


def test_sequence_summary(spark):
    rows = [(1, "a", "user"), (2, "a", "Assistant"), (3, "b", "assistant"), (4, "b", "user"), (5, "c", None), (6, None, "user")]
    got = chat.sequence_summary(spark.createDataFrame(rows, "row_id long, conversation_id string, role string"), ["user", "assistant"]).first()
    assert tuple(got) == (3, round(2 / 3, 6), round(1 / 3, 6))


def test_cause_candidates(spark):
    found = spark.createDataFrame([(1, "cause-void:relation-04", "cause"), (1, "cause-void:relation-04", "cause"), (2, "process:reflow", "process")], "key int, rule string, category string")
    got = [tuple(r)[:3] + (r.texts,) for r in tagging.cause_candidates(found).where("defect = 'insufficient_solder'").orderBy("rank").collect()]
    assert got == [("insufficient_solder", 1, "relation-01", 0), ("insufficient_solder", 2, "relation-04", 1)]


def test_read_json_by_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"v": 1}\n{"v": 2}\n')
    (tmp_path / "b.c.jsonl").write_text('{"v": 3}\n')
    path = str(tmp_path / "*.jsonl")
    assert {(r.source_id, r.v) for r in readers.read_json_by_source(spark, path, "v int").collect()} == {("a", 1), ("a", 2), ("b.c", 3)}
    assert readers.read_json_by_source(spark, path, "v int", ["a"]).count() == 2
    with pytest.raises(ValueError):
        readers.read_json_by_source(spark, path, "v int", ["a", "z"])
