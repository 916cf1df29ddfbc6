"""Similar vectors, packing and mixing on small cases and against brute force."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxgrid.llm import mixing, neighbors, packing, tokens


def vectors(spark, rows, key="id", vector="v"):
    return spark.createDataFrame(rows, f"{key} string, {vector} array<float>")


def clustered(rng, n, spread):
    """Vectors near ``n`` / 20 centres."""
    centres = rng.normal(size=(n // 20, 64))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, 64))) * rng.uniform(0.2, 5, (n, 1))


def brute(queries, rows, k):
    names = np.array([n for n, _ in rows])
    c = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    out = {}
    for name, q in queries:
        near = c @ (np.array(q, dtype=np.float32).astype(float) / np.linalg.norm(q))
        out[name] = [str(names[i]) for i in np.lexsort((names, -near))[:k]]
    return out


def test_neighbors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{i:05d}", v.tolist()) for i, v in enumerate(clustered(rng, 3000, 0.3))]
    queries = [(f"q{i}", (np.array(rows[i * 50][1]) + 0.1 * rng.normal(size=64)).tolist()) for i in range(60)]
    got = neighbors.nearest(vectors(spark, queries), "id", "v", vectors(spark, rows), "id", "v", 10).toPandas()
    want = brute(queries, rows, 10)
    assert got.groupby("query").size().tolist() == [10] * 60
    hits = sum(len(set(g.found) & set(want[q])) for q, g in got.groupby("query"))
    assert hits / 600 >= 0.9


def test_neighbors_far_away_are_scanned_exactly(spark):
    rng = np.random.default_rng(7)
    rows = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(rng.normal(size=(200, 64)))]
    queries = [(f"q{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(5, 64)))]
    got = neighbors.nearest(vectors(spark, queries), "id", "v", vectors(spark, rows), "id", "v", 10).toPandas()
    want = brute(queries, rows, 10)
    assert {q: g.sort_values("rank").found.tolist() for q, g in got.groupby("query")} == want


def test_neighbors_within_the_certain_radius_are_all_found(spark):
    """Every pair of codes within m (r + 1) - 1 bits meets, and a query asked with miss=0 is exact."""
    rng = np.random.default_rng(17)
    assert neighbors.chance_missed(1.0, 0) == 0 and neighbors.chance_missed(0.5, 1) > 0.8
    for radius in neighbors.RADII:
        sure = neighbors.sure_cosine(radius, 0.03)
        assert neighbors.chance_missed(sure, radius) == pytest.approx(0.03, abs=1e-6)
        p = np.arccos(sure) / np.pi
        codes = rng.random((20_000, neighbors.SUBSTRINGS, neighbors.WIDTH)) < p
        assert (codes.sum(axis=2) > radius).all(axis=1).mean() == pytest.approx(0.03, abs=0.01)
        assert (codes.sum(axis=(1, 2)) <= neighbors.furthest(sure)).mean() > 0.995
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(clustered(rng, 1000, 1.0))]
    queries = [(f"q{i}", rows[i * 9][1]) for i in range(20)]
    got = neighbors.nearest(vectors(spark, queries), "id", "v", vectors(spark, rows), "id", "v", 10, miss=0).toPandas()
    assert {q: g.sort_values("rank").found.tolist() for q, g in got.groupby("query")} == brute(queries, rows, 10)


def test_unusable_vectors_copies_and_clashing_columns(spark):
    one = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    rows = [(f"copy{i:02d}", one) for i in range(30)] + [("near", near), ("near", near), ("none", None), ("short", [1.0]), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("hole", [None] * 64), (None, one)]
    queries = [("q", [3.0] + [0.0] * 63), ("q", [3.0] + [0.0] * 63), ("bad", None), ("worse", [0.0] * 64), (None, one)]
    q, r = (vectors(spark, x).withColumn("found", F.lit("clash")).withColumn("query", F.lit(1)) for x in (queries, rows))
    got = neighbors.nearest(q, "id", "v", r, "id", "v", 10).toPandas()
    assert got.sort_values("rank").found.tolist() == [f"copy{i:02d}" for i in range(10)] and set(got["query"]) == {"q"}
    got = neighbors.nearest(q, "id", "v", r, "id", "v", 40).toPandas()
    assert len(got) == 31 and got.sort_values("rank").found.iloc[-1] == "near"
    assert neighbors.nearest(q.limit(0), "id", "v", r, "id", "v").count() == 0
    assert neighbors.nearest(q, "id", "v", r.limit(0), "id", "v").count() == 0


def fewest(sizes, capacity):
    """Least number of containers, by trying all partitions of a few items."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_bin_completion_against_all_partitions(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 31, 9).tolist()
    bins = packing.complete_bins(sizes, 30, steps=200)
    assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= 30 for b in bins)
    assert -(-sum(sizes) // 30) <= packing.least_bins(sizes, 30) <= fewest(sizes, 30)
    assert len(bins) <= fewest(sizes, 30)


def test_bin_completion_beats_best_fit():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 45, 35, 20, 55, 30, 15, 60, 25, 15]
    assert len(packing.complete_bins(sizes, 100)) <= len(packing.best_fit(sizes, 100))
    assert packing.complete_bins([], 10) == [] and packing.complete_bins([10, 10], 10) == [[10], [10]]


@pytest.mark.parametrize("seed", [0, 3, 6, 10])
def test_bin_completion_of_many_items_per_container(seed):
    rng, sizes = np.random.default_rng(seed), []
    for _ in range(4):  # six items fill each of four containers
        cuts = sorted(rng.choice(np.arange(1, 100), 5, replace=False).tolist())
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 100])]
    bins = packing.complete_bins(sizes, 100, steps=50)
    assert len(packing.best_fit(sizes, 100)) == 5 and len(bins) == 4
    assert sorted(itertools.chain(*bins)) == sorted(sizes) and all(sum(b) <= 100 for b in bins)


@pytest.mark.parametrize(("items", "capacity"), [(4, 1000), (5, 8192), (8, 1000)])
def test_planted_perfect_packings_at_the_steps_of_production(items, capacity):
    rng, sizes = np.random.default_rng(items), []
    for _ in range(60):
        cuts = sorted(rng.choice(np.arange(1, capacity), items - 1, replace=False).tolist())
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, capacity])]
    assert len(packing.best_fit(sizes, capacity)) == 61 and len(packing.complete_bins(sizes, capacity)) == 60


def test_lower_bound_and_dominance():
    assert packing.least_bins([60] * 5 + [30] * 2, 100) == 5 and packing.least_bins([51] * 3 + [50] * 3, 100) == 5 and packing.least_bins([], 10) == 0
    stock = packing.Stock([50, 30, 20, 40, 10], 100)
    ways = list(packing.fillings(stock, 60, 0))
    assert (50, 10) in ways and (40, 20) in ways and (30, 20, 10) not in ways


def test_pack(spark):
    rng = np.random.default_rng(8)
    docs = [(i, int(n)) for i, n in enumerate(rng.integers(0, 700, 500))] + [(1000, 5000), (1001, 1024), (1002, None), (1003, 0), (None, 5), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, tokens long").withColumn("bin", F.lit("clash"))
    caps = spark.createDataFrame([("a", 512), ("b", 2048), ("a", 512), (None, None), ("z", 0)], "capacity_name string, capacity_tokens int")
    got = packing.pack(df, caps, block=100).toPandas()
    sizes = {i: n or 0 for i, n in docs if i is not None and i != 7} | {7: docs[7][1]}
    for name, capacity in (("a", 512), ("b", 2048)):
        mine = got[got.capacity_name == name]
        assert mine.groupby("doc_id").tokens.sum().to_dict() == sizes
        split = mine.groupby("doc_id").size()
        assert set(split[split > 1].index) == {i for i, n in sizes.items() if n > capacity}
        bins = mine.groupby("container_id").agg(t=("tokens", "sum"), u=("unused", "first"), n=("unused", "nunique"))
        assert (bins.t + bins.u == capacity).all() and (bins.n == 1).all()
        assert len(bins) <= -(-mine.tokens.sum() // capacity) * 1.01 + 1
    assert set(got.capacity_name) == {"a", "b"}
    assert packing.pack(df.limit(0), caps).count() == 0 and packing.pack(df, caps.limit(0)).count() == 0


def water(sources, total):
    """Clamping round by round: (weight, cap) to what each gets."""
    granted, open_ = [0.0] * len(sources), set(range(len(sources)))
    while open_:
        left = total - sum(granted[i] for i in range(len(sources)) if i not in open_)
        weight = sum(sources[i][0] for i in open_)
        over = {i for i in open_ if sources[i][0] / weight * left >= sources[i][1]}
        if not over:
            for i in open_:
                granted[i] = sources[i][0] / weight * left
            break
        for i in over:
            granted[i] = float(sources[i][1])
        open_ -= over
    return granted


@pytest.mark.parametrize("seed", range(6))
def test_water_filling_against_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{i}", float(rng.uniform(0.01, 1)), int(rng.integers(1, 6)), int(rng.integers(0, 1000))) for i in range(9)]
    total = float(rng.uniform(500, 6000))
    got = {r.source_id: r.granted for r in mixing.water_fill(spark.createDataFrame(rows, "source_id string, target_share double, max_repeats int, size long"), total).collect()}
    want = water([(w, m * n) for _, w, m, n in rows], min(total, sum(m * n for *_, m, n in rows)))
    assert [got[f"s{i}"] for i in range(9)] == pytest.approx(want)


def test_mix(spark):
    rng = np.random.default_rng(9)
    docs = [(i, "abc"[i % 3], int(n)) for i, n in enumerate(rng.integers(1, 50, 3000))] + [(9000, None, 10), (9001, "unlisted", 10), (9002, "a", None), (0, "a", 0), (None, "a", 9)]
    targets = [("a", 0.7, 1), ("b", 0.2, 4), ("c", 0.1, 2), ("gone", 0.3, 5), ("a", 0.7, 1), ("c2", None, None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("source_id", F.lit("clash")).withColumn("h", F.lit(0))
    want = spark.createDataFrame(targets, "source_id string, target_share double, max_repeats int")
    chosen, shares = (x.toPandas() for x in mixing.mix(df, want))
    again = mixing.mix(df.repartition(5), want)[0].toPandas()
    key = ["doc_id", "source_id", "tokens", "repeats"]
    assert chosen[key].sort_values("doc_id").values.tolist() == again[key].sort_values("doc_id").values.tolist()
    shares = shares.set_index("source_id")
    assert shares.actual_share.sum() == pytest.approx(1)
    assert (chosen.repeats <= chosen.source_id.map({"a": 1, "b": 4, "c": 2})).all() and not chosen.doc_id.duplicated().any()
    assert abs(shares.actual - shares.granted).max() <= 50
    assert shares.loc["a", "clamped"] and shares.loc["gone", "actual"] == 0 and shares.loc["b", "granted"] / shares.loc["c", "granted"] == pytest.approx(2)
    empty = mixing.mix(df.limit(0), want)
    assert empty[0].count() == 0 and empty[1].count() == 5
    assert mixing.mix(df, want.limit(0))[0].count() == 0


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no tokenizer files")
def test_tokens(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "焊" * 1000), (5, "a b " * 50_000)], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = tokens.with_tokens(rows, "text").toPandas().set_index("doc_id").tokens.to_dict()
    assert (got[1], got[2], got[3]) == (2, 0, 0) and got[4] >= 1000 and got[5] >= 100_000
    assert isinstance(pd.Series(got).sum(), np.integer)
