"""Most similar vectors by multi-index hashing (problem 4).

Binary codes come from a learned rotation (iterative quantisation on a bounded sample; every row is
indexed). A code is split into substrings of a fixed width and indexed by each. A code within Hamming radius
m (r + 1) - 1 of a query agrees with it up to r bits in at least one of m substrings (pigeonhole), so probing
each substring's ball of radius r retrieves all of these, and most of those further away. What is retrieved
is compared by whole codes and reranked by the cosine of the float vectors.

A query is done once the chance that probing missed a vector as near as its k-th is small: two vectors at an
angle differ in a bit with probability angle / pi, which gives the chance that no substring brings them
together. The radius of the balls is raised in rounds for the other queries, and what is left after the
last round is scanned exactly against all rows, in blocks. So the probes of a query are bounded at any size
of the table, and queries without near vectors get exact answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.operators.retrieval import best, dense_topk, unit_vectors
from fluxgrid.sources.scratch import cut

#: Rows, at most about twice as many, on which the rotation is learned.
SAMPLE = 20_000
#: Substrings of a code and their bits; four substrings make a word of 64 bits.
SUBSTRINGS, WIDTH = 12, 16
#: Radius of the balls probed in each substring, round by round: 12, then 204 probes for a query.
RADII = (0, 1)
#: Chance, at most, that a vector as near as the k-th of a finished query was missed.
MISS = 0.03


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """(dim, bits): orthogonal rotations, side by side, that bring unit vectors close to corners of a cube."""
    rng, dim, parts = np.random.default_rng(seed), sample.shape[1], []
    for _ in range(-(-bits // dim)):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(sample @ turn > 0, 1.0, -1.0).T @ sample)
            turn = (u @ w).T
        parts.append(turn)
    return np.concatenate(parts, axis=1)[:, :bits].astype(np.float32)


def chance_missed(cosine: float, radius: int) -> float:
    """Chance that no substring of two codes agrees up to ``radius`` bits, for vectors of this cosine."""
    p = acos(max(-1.0, min(1.0, cosine))) / pi
    return (1 - sum(comb(WIDTH, i) * p**i * (1 - p) ** (WIDTH - i) for i in range(radius + 1))) ** SUBSTRINGS


def sure_cosine(radius: int, miss: float) -> float:
    """The least cosine at which vectors are missed with a chance of at most ``miss``."""
    low, high = 0.0, 1.0
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (low, middle) if chance_missed(middle, radius) <= miss else (middle, high)
    return high


def furthest(cosine: float) -> int:
    """Bits by which the codes of vectors of at least this cosine differ at most, but for three standard deviations."""
    bits, p = SUBSTRINGS * WIDTH, acos(cosine) / pi
    return ceil(bits * p + 3 * sqrt(bits * p * (1 - p)))


def _encoder(rotation: np.ndarray, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    words = rotation.shape[1] // 64

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = unit_vectors(batch.column(batch.num_columns - 1), dim)
            bits = np.packbits(unit.astype(np.float32) @ rotation > 0, axis=1, bitorder="little").view("<i8")
            kept = [c.take(pa.array(rows)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(words))], [*batch.schema.names[:-1], *(f"w{i}" for i in range(words))])

    return encode


def _cosines(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, a = unit_vectors(batch.column("qv"), dim)
            _, b = unit_vectors(batch.column("cv"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("found"), pa.array(np.round((a * b).sum(axis=1), 12))], ["query", "found", "cosine"])

    return measure


def nearest(queries: DataFrame, query_key: str, query_vector: str, rows: DataFrame, key: str, vector: str, k: int = 10, dim: int = 64, miss: float = MISS) -> DataFrame:
    """query, found, cosine, rank: for each usable query vector the ``k`` most similar rows.

    Vectors that are null, of another length than ``dim``, hold null, NaN or infinite values or only zeros
    take no part, on either side; norms don't matter. Repeated rows count once, ties go to the smaller key.
    Fewer than ``k`` rows come out only if there are fewer usable keys. Of more than ``k`` copies of one
    vector only the ``k`` smallest keys can be among the best, so a group of copies costs no more than that.
    ``miss`` is the loss that is accepted; 0 asks for exact results, and every query is scanned.
    """
    queries = queries.select(F.col(query_key).cast("string").alias("query"), F.col(query_vector).cast("array<float>").alias("qv")).where("query IS NOT NULL AND qv IS NOT NULL")
    rows = rows.select(F.col(key).cast("string").alias("found"), F.col(vector).cast("array<float>").alias("cv")).where(f"found IS NOT NULL AND cv IS NOT NULL AND size(cv) = {dim}")
    if miss <= 0:
        return dense_topk(queries, rows, k, dim)
    bits, words = SUBSTRINGS * WIDTH, [f"w{i}" for i in range(SUBSTRINGS * WIDTH // 64)]
    share, spread = min(1.0, SAMPLE / max(rows.count(), 1)), 2**63
    sample = rows.where(F.xxhash64("found", F.lit("sample")) <= min(spread - 1, int(share * 2 * spread) - spread)).select("cv").limit(2 * SAMPLE).toArrow()
    encode = _encoder(learn_rotation(unit_vectors(sample.column("cv"), dim)[1], bits), dim)
    code = ", ".join(f"{w} long" for w in words)
    # Ids are hashes: a collision only adds a candidate.
    coded = rows.select("found", F.xxhash64("found", "cv").alias("id"), F.xxhash64("cv").alias("copy"), "cv").mapInArrow(encode, f"found string, id long, copy long, {code}")
    coded = _few_copies(cut(coded, "codes"), k)
    substring = lambda j, prefix="": F.shiftright(F.col(f"{prefix}w{j * WIDTH // 64}"), j * WIDTH % 64).bitwiseAND((1 << WIDTH) - 1).cast("int")
    index = coded.select("id", *words, F.explode(F.array(*(F.lit(j << WIDTH) + substring(j) for j in range(SUBSTRINGS)))).alias("place"))
    asked = queries.select("query", F.xxhash64("query", "qv").alias("q"), "qv").distinct()
    codes = cut(asked.select("query", "q", "qv").mapInArrow(encode, f"query string, q long, {code}"), "asked").select("query", "q", *(F.col(w).alias(f"q{w}") for w in words))
    vectors = rows.select(F.xxhash64("found", "cv").alias("id"), "found", "cv")
    apart = sum((F.bit_count(F.col(f"q{w}").bitwiseXOR(F.col(w))) for w in words[1:]), F.bit_count(F.col(f"q{words[0]}").bitwiseXOR(F.col(words[0]))))
    finished, open_ = [], codes
    for radius in RADII:
        sure = sure_cosine(radius, miss)
        flips = F.array(*(F.lit(sum(1 << b for b in at)) for d in range(radius + 1) for at in combinations(range(WIDTH), d)))
        ball = lambda j: F.transform(flips, lambda x: F.lit(j << WIDTH) + substring(j, "q").bitwiseXOR(x))
        balls = F.array(*(ball(j) for j in range(SUBSTRINGS)))
        # Spark sizes the probes by the queries they come from and would broadcast them; they are merged instead.
        probes = open_.select("q", *(f"q{w}" for w in words), F.explode(F.flatten(balls)).alias("place")).hint("merge")
        # A finished query's best have at least the sure cosine: what is further away can't be among them.
        met = probes.join(index, "place").where(apart <= furthest(sure)).select("q", "id").distinct()
        pairs = met.join(vectors, "id").join(asked, "q")
        hits = cut(best(pairs.select("query", "found", "qv", "cv").mapInArrow(_cosines(dim), "query string, found string, cosine double"), k), "hits")
        done = hits.where(F.col("cosine") >= sure).groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query")
        finished.append(hits.join(done, "query", "left_semi"))
        open_ = cut(open_.join(done, "query", "left_anti"), "open")
    out = dense_topk(asked.join(open_.select("q"), "q", "left_semi"), rows, k, dim)
    for part in finished:
        out = out.unionByName(part)
    return out.select("query", "found", "cosine", "rank")


def _few_copies(coded: DataFrame, k: int) -> DataFrame:
    """``coded`` without all but the ``k`` smallest keys of each vector's copies, which are counted before anything is sorted."""
    crowds = coded.groupBy("copy").agg(F.count("*").alias("n")).where(F.col("n") > k).select("copy")
    crowded = coded.join(crowds, "copy", "left_semi").distinct()
    kept = crowded.withColumn("place", F.row_number().over(Window.partitionBy("copy").orderBy("found"))).where(F.col("place") <= k).drop("place")
    return coded.join(crowds, "copy", "left_anti").unionByName(kept).drop("copy", "found")
