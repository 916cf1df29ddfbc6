"""Dense and sparse retrieval, rank fusion and re-ranking."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx
from fluxgrid.operators.blocks import in_blocks, top_columns
from fluxgrid.sources.scratch import cut

RRF_K = 60
#: Queries of a block, vectors and documents of a group, that meet in a task.
BLOCK, GROUP, PAGES = 2_000, 20_000, 1_000
#: Of the search over pages: those of a slice, weights of a slice, pages and sets of terms of a task at most, check sums of terms.
SLICE, CELLS, SPAN, SETS, SUMS = 4_096, 8_000_000, 50_000, 40_000, 1 << 20


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors (not null, ``dim`` finite values, not all zero), and the vectors at length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    right = np.flatnonzero((np.diff(ends) == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null values become NaN
    rows = values[ends[right][:, None] + np.arange(dim)] if len(right) else np.zeros((0, dim))
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(rows).max(axis=1, initial=0)
        fine = np.isfinite(rows).all(axis=1) & (scale > 0)
        rows = rows[fine] / scale[fine][:, None]
    return right[fine], rows / np.linalg.norm(rows, axis=1, keepdims=True)


def best(scored: DataFrame, k: int) -> DataFrame:
    """query, found, cosine, rank: the k best of each query, ties by name; a pair counts with its highest score."""
    scored = scored.groupBy("query", "found").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "found")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(queries: DataFrame, rows: DataFrame, k: int, dim: int = 64) -> DataFrame:
    """Exact cosine top k: query, found, cosine, rank of queries (query, qv) against rows (found, cv).

    Blocks of BLOCK queries meet groups of GROUP rows; a task multiplies the two and keeps the ``k`` best of
    the group, so what is shuffled after that follows queries times groups, not pairs. Unusable vectors take
    no part; a name with several vectors counts with the nearest; ties go to the smaller name. Cosines are
    rounded to 12 digits, so that copies tie wherever they are computed.
    """
    queries, rows = queries.select("query", "qv").where("query IS NOT NULL AND qv IS NOT NULL").distinct(), rows.select("found", "cv").where(f"found IS NOT NULL AND size(cv) = {dim}")
    sizes = queries.agg(F.count("*").alias("n")).collect()[0].n, rows.count()

    def scan(asked: pa.Table, group: pa.Table) -> pa.Table:
        at, unit = unit_vectors(asked.column("qv"), dim)
        row, vectors = unit_vectors(group.column("cv"), dim)
        queries_ = asked.column("query").combine_chunks().take(pa.array(at))
        # One column per name, in order of the names: of rows that share it the nearest counts.
        names = group.column("found").combine_chunks().take(pa.array(row))
        order = pc.sort_indices(names).to_numpy()
        names, vectors = names.take(pa.array(order)), vectors[order]
        starts = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)]) if len(names) else np.zeros(0, int)
        out = [[], [], []]
        for low in range(0, len(unit) if len(starts) else 0, 500):
            near = np.maximum.reduceat(np.round(unit[low : low + 500] @ vectors.T, 12), starts, axis=1)
            q, c = top_columns(near, k)
            for part, values in zip(out, (q + low, starts[c], near[q, c]), strict=True):
                part.append(values)
        q, c, s = (np.concatenate(x) if x else np.zeros(0, int) for x in out)
        return pa.table({"query": queries_.take(pa.array(q)).cast(pa.string()), "found": names.take(pa.array(c)).cast(pa.string()), "cosine": pa.array(s.astype(float))})

    pairs = in_blocks(queries, rows, F.col("query"), F.struct("found", "cv"), *(max(1, -(-n // size)) for n, size in zip(sizes, (BLOCK, GROUP), strict=True)), scan, "query string, found string, cosine double")
    return best(pairs, k)


def sparse_weights(docs: DataFrame) -> DataFrame:
    """Postings (found, term, weight) of docs (found, terms): term count times inverse document frequency.

    Every term of positive weight is kept; a term on all documents has none. Counts are written once.
    """
    counts = cut(docs.select("found", F.explode("terms").alias("term")).groupBy("found", "term").agg(F.count("*").alias("tf")), "terms")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    df = df.crossJoin(n).select("term", F.log(F.col("n") / F.col("df")).alias("idf")).where("idf > 0")
    return counts.join(df, "term").select("found", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def top_pages(sizes: np.ndarray, term: np.ndarray, gain: np.ndarray, page: np.ndarray, word: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, page, score) of the ``k`` best pages of each question, scores above 0, rounded to 6 digits, ties to the smaller page.

    Question i has the next ``sizes[i]`` of ``term`` with their ``gain``; ``page``, ``word``, ``weight`` are entries, one
    per page and word. Pages that have the same frequent words stand together in slices. A slice is left out for a question
    if no page of it can reach the k-th score so far: the sum over its terms of the slice's highest weight bounds them all.
    """
    if not len(page) or not len(term):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    pages, words, wide = int(page.max()) + 1, int(max(word.max(), term.max())) + 1, np.arange(sizes.max()) < sizes[:, None]
    ids, gains = np.full(wide.shape, words), np.zeros(wide.shape)
    ids[wide], gains[wide] = term, gain
    often = np.argsort(-np.bincount(word, minlength=words), kind="stable")[:62]
    bit = np.zeros(words, np.int64)
    bit[often] = 1 << np.arange(61, 61 - len(often), -1, dtype=np.int64)
    has = np.zeros(pages, np.int64)
    np.bitwise_or.at(has, page, bit[word])
    order = np.argsort(has, kind="stable")
    at = np.argsort(order)[page]
    by = np.argsort(at, kind="stable")
    at, word, weight = at[by], word[by], weight[by]
    low, held = np.zeros(len(sizes)), [(np.zeros(0, int), np.zeros(0))] * len(sizes)
    wide = min(pages, max(SLICE // 16, min(SLICE, CELLS // words)))
    for first in range(0, pages, wide):
        entries = slice(*np.searchsorted(at, [first, first + wide]))
        here, row = np.unique(word[entries], return_inverse=True)
        table, most, rows = np.zeros((len(here), wide)), np.zeros(words + 1), np.zeros(words + 1, int)
        table[row, at[entries] - first] = weight[entries]
        most[here], rows[here] = table.max(axis=1), np.arange(len(here))
        for q in np.flatnonzero((most[ids] * gains).sum(axis=1) > low):
            there = most[ids[q]] > 0
            score = gains[q][there] @ table[rows[ids[q][there]]]
            hit = np.flatnonzero(score > low[q])
            if len(hit) > k:
                hit = hit[score[hit] >= np.partition(score[hit], -k)[-k] - 1e-6]
            if len(hit):
                c, s = np.r_[held[q][0], order[first + hit]], np.r_[held[q][1], np.round(score[hit], 6)]
                best_ = np.lexsort((c, -s))[:k]
                held[q] = c[best_], s[best_]
                if len(best_) == k:
                    low[q] = max(0.0, s[best_[-1]] - 1e-6)
    found = [len(c) for c, _ in held]
    return np.repeat(np.arange(len(sizes)), found), np.concatenate([c for c, _ in held]), np.concatenate([s for _, s in held])


def sparse_topk(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """query, found, score, rank by the dot product over shared terms; without a shared term there is no row.

    A frequent term meets nearly every question: joined by term, it would be one hot key with questions times
    documents rows. Blocks of questions meet groups of documents instead (``top_pages``), and only the ``k``
    best of a group go on. Scores are rounded to 6 digits, ties go to the smaller name.
    """
    asked = cut(queries.select("query", F.explode(F.array_distinct("terms")).alias("term")).where("query IS NOT NULL").distinct(), "asked")
    postings = cut(postings.join(asked.select("term").distinct(), "term", "left_semi").select("found", "term", "weight"), "postings")
    questions, documents = asked.agg(F.approx_count_distinct("query")).collect()[0][0], postings.agg(F.approx_count_distinct("found")).collect()[0][0]

    def scan(wanted: pa.Table, group: pa.Table) -> pa.Table:
        terms = pc.unique(group.column("term"))
        wanted = wanted.filter(pc.is_in(wanted.column("term"), terms))
        in_order = lambda names: names.take(pc.sort_indices(names))
        place = lambda column, names: pc.index_in(column, names).to_numpy()
        names, pages = in_order(pc.unique(wanted.column("query"))), in_order(pc.unique(group.column("found")))
        query = place(wanted.column("query"), names)
        by = np.argsort(query, kind="stable")
        sizes, word = np.bincount(query, minlength=len(names)), place(wanted.column("term"), terms)[by]
        i, c, s = top_pages(sizes, word, np.ones(len(word)), place(group.column("found"), pages), place(group.column("term"), terms), group.column("weight").to_numpy(), k)
        return pa.table({"query": names.take(pa.array(i)), "found": pages.take(pa.array(c)), "score": pa.array(s)})

    scored = in_blocks(asked, postings, F.col("query"), F.col("found"), max(1, -(-questions // BLOCK)), max(1, -(-documents // PAGES)), scan, "query string, found string, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def page_terms(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """found, terms of the pages of ``lines`` (distinct rows): their words and pairs of Chinese characters, sorted, blank between, as often as they occur.

    Of terms that aren't in ``asked`` (term) most are left out, by a bitmap of 2**20 check sums; all that are in it stay.
    Words are taken where the lines stand and only those are shuffled, not the text. A line goes with its ids, a hash of
    the whole row, by which equal rows are told, and its outer Chinese characters, for the pairs over its ends.
    """
    sums = asked.select(F.expr(f"CAST(crc32(encode(term, 'UTF-8')) % {SUMS} AS INT) AS sum")).distinct().toArrow().column("sum").to_numpy()
    bits = np.zeros(SUMS, bool)
    bits[sums] = True
    bits = np.packbits(bits).tobytes()

    class Known(dict):
        def __missing__(self, term: str) -> bool:
            n = zlib.crc32(term.encode()) % SUMS
            self[term] = out = bool(bits[n >> 3] >> (7 - (n & 7)) & 1)
            return out

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, han = re.compile("[a-z0-9äöüß]+").findall, re.compile("[\u4e00-\u9fff]").findall
        for batch in batches:
            known, said = Known(), []
            for text in batch.column(4).to_numpy(zero_copy_only=False).tolist():
                terms = [w for w in word(text) if known[w]] if text else []
                if text and not text.isascii() and (chars := han(text)):
                    terms += [p for x, y in zip(chars, chars[1:], strict=False) if known[p := x + y]]
                    terms.append("\t" + chars[0] + chars[-1])
                said.append(" ".join(terms))
            page = batch.column(0).dictionary_encode(null_encoding="encode")
            code = page.indices.to_numpy()
            by, ends = np.argsort(code, kind="stable"), np.r_[0, np.cumsum(np.bincount(code, minlength=len(page.dictionary)))]
            parts = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), column.take(pa.array(by))) for column in (*batch.columns[1:4], pa.array(said, pa.string()))]
            yield pa.RecordBatch.from_arrays([page.dictionary, *parts[:3], pc.binary_join(parts[3], "\n")], ["found", "no", "line", "same", "said"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = pc.split_pattern(batch.column(4), "\n")
            page = np.repeat(np.arange(len(said)), np.diff(said.offsets.to_numpy()))
            keys = [page, *(key for i in (1, 2) for key in (batch.column(i).flatten().is_null().to_numpy(zero_copy_only=False), batch.column(i).flatten().fill_null(0).to_numpy())), batch.column(3).flatten().to_numpy()]
            by = np.lexsort(keys[::-1])
            once = by[np.r_[True, np.any([np.diff(key[by].astype(np.int64)) != 0 for key in keys], axis=0)]] if len(by) else by
            texts, ends, out = said.flatten().to_numpy(zero_copy_only=False)[once].tolist(), np.r_[0, np.cumsum(np.bincount(page[once], minlength=len(said)))].tolist(), []
            for first, end in zip(ends, ends[1:], strict=False):
                terms = " ".join(texts[first:end]).split(" ")
                if outer := [term[1:] for term in terms if term[:1] == "\t"]:
                    terms = [term for term in terms if term[:1] != "\t"] + [x[1] + y[0] for x, y in zip(outer, outer[1:], strict=False)]
                out.append(" ".join(sorted(filter(None, terms))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["found", "terms"])

    same = F.xxhash64(*lines.columns, *(F.col(c).isNull() for c in lines.columns))
    rows = lines.select("page_id", F.col("line_no").cast("long"), F.col("line_id").cast("long"), same.alias("same"), F.lower("text").alias("text"))
    parts = rows.mapInArrow(take, "found string, no array<long>, line array<long>, same array<long>, said string").groupBy("found").agg(F.collect_list(F.struct("no", "line", "same", "said")).alias("parts"))
    whole = [F.flatten(F.col(f"parts.{c}")).alias(c) for c in ("no", "line", "same")]
    return parts.select("found", *whole, F.array_join("parts.said", "\n").alias("said")).mapInArrow(join, "found string, terms string")


def search_pages(questions: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """query, found, score, rank: the ``k`` best pages of ``lines`` for ``questions`` (query, text), as by ``sparse_weights`` and ``sparse_topk``.

    Made for tables of some size: a page is carried as the terms that are asked for, once per block of questions, and
    questions that ask for the same terms are answered once. Groups of pages are as few as the cores, or as SPAN allows,
    since each of them gives ``k`` pages for every question. Rows of a question with several texts ask for all their terms.
    """
    spark = lines.sparkSession
    asked = cut(questions.select("query", F.explode(tx.terms(F.col("text"))).alias("term")).distinct(), "asked")
    pages = cut(page_terms(lines, asked.select("term")), "pages")
    n = pages.count()
    df = pages.select(F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).groupBy("term").agg(F.count("*").cast("int").alias("df")).where(F.col("df") < n)
    wanted = asked.join(df, "term").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("t"))
    wanted = cut(wanted.select("query", F.array_join("t.term", " ").alias("terms"), F.col("t.df").alias("df")), "wanted")
    sets = cut(wanted.groupBy("terms").agg(F.first("df").alias("df")).withColumn("set", F.monotonically_increasing_id()), "sets")

    def scan(sets: pa.Table, pages: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("minus", pa.float64()), ("nil", pa.bool_()), ("found", pa.string())]))
        if not sets.num_rows or not pages.num_rows:
            return pa.table({"set": pa.array([], pa.int64()), "best": pa.array([], kind)})
        flat = lambda column: column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        terms = pc.split_pattern(flat(sets.column("terms")), " ")
        sizes, asked, gain = np.diff(terms.offsets.to_numpy()), pc.dictionary_encode(terms.flatten()), np.log(n / flat(sets.column("df")).flatten().to_numpy())
        pages = pages.take(pc.sort_indices(pages.column("found")))
        have = pc.split_pattern(flat(pages.column("terms")), " ")
        page, word = np.repeat(np.arange(len(have)), np.diff(have.offsets.to_numpy())), pc.fill_null(pc.index_in(have.flatten(), asked.dictionary), -1).to_numpy()
        entry, times = np.unique(page[word >= 0] * len(asked.dictionary) + word[word >= 0], return_counts=True)
        i, c, s = top_pages(sizes, asked.indices.to_numpy(), gain, entry // len(asked.dictionary), entry % len(asked.dictionary), times.astype(float), k)
        names = flat(pages.column("found")).take(pa.array(c))
        found = np.unique(i, return_counts=True)
        best_ = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found[1])], pa.int32()), pa.StructArray.from_arrays([pa.array(0.0 - s), pc.is_null(names), names], ["minus", "nil", "found"]))
        return pa.table({"set": flat(sets.column("set")).take(pa.array(found[0])), "best": best_.cast(kind)})

    cores, size = spark.sparkContext.defaultParallelism, sets.count()
    groups = max(1, -(-n // SPAN), min(cores, 8, n // PAGES))
    blocks = max(1, -(-size // SETS), min(-(-cores // groups), size // BLOCK))
    scored = in_blocks(sets, pages, F.col("set"), F.col("found"), blocks, groups, scan, "set long, best array<struct<minus: double, nil: boolean, found: string>>")
    scored = scored.groupBy("set").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    scored = wanted.select("query", "terms").join(sets.select("terms", "set"), "terms").join(scored, "set").select("query", F.posexplode("best").alias("at", "b"))
    return scored.select("query", F.col("b.found").alias("found"), (F.lit(0.0) - F.col("b.minus")).alias("score"), (F.col("at") + 1).alias("rank"))


def rrf(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    """weight / (k + rank), 0 where the rank is missing."""
    return F.coalesce(F.lit(weight) / (F.lit(k) + rank), F.lit(0.0))


def fuse(dense: DataFrame, sparse: DataFrame, keep: int = 10) -> DataFrame:
    """Full outer reciprocal rank fusion of two channels (query, found, rank).

    Order: score, then the better of the two ranks (a missing one is skipped), then the name.
    """
    d, s = dense.select("query", "found", F.col("rank").alias("dense_rank")), sparse.select("query", "found", F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query", "found"], "full_outer").withColumn("score", rrf(F.col("dense_rank")) + rrf(F.col("sparse_rank")))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.least("dense_rank", "sparse_rank"), "found")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def rerank(fused: DataFrame, scores: DataFrame) -> DataFrame:
    """``fused`` with rerank_rank by scores (query, found, overlap); ties keep the fused order."""
    order = Window.partitionBy("query").orderBy(F.desc("overlap"), "rank", "found")
    return fused.join(scores, ["query", "found"], "left").na.fill(0.0, ["overlap"]).withColumn("rerank_rank", F.row_number().over(order))


def rank_fusion(reranked: DataFrame, weight: float | Column = 0.73) -> DataFrame:
    """final_rank by (1 - w) / (60 + rank) + w / (60 + rerank_rank); ties by both ranks, then the name.

    ``weight`` may be a column; the ranking is then made for each of its values.
    """
    w = F.lit(weight) if isinstance(weight, float) else weight
    score = (1 - w) / (RRF_K + F.col("rank")) + w / (RRF_K + F.col("rerank_rank"))
    keys = ["query"] if isinstance(weight, float) else ["query", "w"]
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("final_score", 12)), F.least("rank", "rerank_rank"), "rank", "rerank_rank", "found")
    return reranked.withColumn("final_score", score).withColumn("final_rank", F.row_number().over(order))


def facets(columns: dict[str, list[str]]) -> Column:
    """OR within a field, AND across fields, an empty list asks for nothing. Array fields hold if they overlap."""
    out = F.lit(True)
    for name, values in columns.items():
        if values:
            array, field = name.endswith("[]"), name.removesuffix("[]")
            out = out & (F.arrays_overlap(field, F.array(*(F.lit(v) for v in values))) if array else F.col(field).isin(values))
    return out
