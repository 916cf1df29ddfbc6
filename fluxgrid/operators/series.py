"""Numeric profiles: windows of a process, domains, routes and curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Width of the bands of log1p(volume) in which volumes are put in order.
VOLUME_BAND = 0.01


def window_index(value: Column, low: float, high: float) -> Column:
    """Distance from the middle of [low, high] in percent of half its width; 100 at its ends."""
    return F.abs(value - (low + high) / 2) / ((high - low) / 2) * 100


def worst_window(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """``rows`` with index_<column> of each limited column, worst (the largest) and qualified (worst rounded to 2 <= 100)."""
    for name, (low, high) in limits.items():
        rows = rows.withColumn(f"index_{name}", window_index(F.col(name), low, high))
    rows = rows.withColumn("worst", F.greatest(*(F.col(f"index_{name}") for name in limits)))
    return rows.withColumn("qualified", F.round("worst", 2) <= 100)


def outside(columns: dict[str, tuple[float, float]]) -> Column:
    """Names of the columns outside their bounds or null, in order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(F.col(c).between(low, high), F.lit(False)), F.lit(c)) for c, (low, high) in columns.items()))), ",")


def rising(values: Column, slack: float = 1e-12) -> Column:
    """Whether an array never falls by more than ``slack``."""
    return F.coalesce(F.forall(F.zip_with(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: b - a), lambda d: d >= -slack), F.lit(True))


def falls(values: Column) -> Column:
    """Sum of the squares of all falls of an array."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.aggregate(F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), lambda a, b: F.pow(F.greatest(a - b, F.lit(0.0)), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def nearest_route(points: DataFrame, routes: DataFrame, by: str) -> DataFrame:
    """Each point (point, x, y, v) with the nearest route (route, rx, ry, rv) of its ``by``.

    Nearness: difference of log1p of the volumes, then the distance in the plane, then the route's name. Only
    the next volumes below and above a point's own can be nearest: they are found by order within narrow bands
    of volume, and over bands by a table of their ends, so neither pairs nor a whole ``by`` meet in one
    task. Points or routes without a volume, and points of a ``by`` without routes, give no row.
    """
    places = routes.where("rv IS NOT NULL").groupBy(by, F.col("rv").cast("double").alias("rv"), "rx", "ry").agg(F.min("route").alias("route"))
    points = points.where("v IS NOT NULL").withColumn("v", F.col("v").cast("double"))
    stops = points.select(by, "v", F.lit(None).cast("double").alias("rv")).distinct().unionByName(places.select(by, F.col("rv").alias("v"), "rv").distinct())
    stops = stops.withColumn("band", F.floor(F.log1p("v") / VOLUME_BAND))
    ends = stops.groupBy(by, "band").agg(F.max("rv").alias("top"), F.min("rv").alias("bottom"))
    order = Window.partitionBy(by).orderBy("band")
    below = F.last("top", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    above = F.first("bottom", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(by, "band", below.alias("far_below"), above.alias("far_above"))
    inner = Window.partitionBy(by, "band").orderBy("v")
    below = F.last("rv", ignorenulls=True).over(inner.rangeBetween(Window.unboundedPreceding, 0))
    above = F.first("rv", ignorenulls=True).over(inner.rangeBetween(0, Window.unboundedFollowing))
    near = stops.withColumn("below", below).withColumn("above", above).where("rv IS NULL").join(ends, [by, "band"])
    near = near.select(by, "v", F.explode(F.array_distinct(F.array_compact(F.array(F.coalesce("below", "far_below"), F.coalesce("above", "far_above"))))).alias("rv"))
    pairs = points.join(near, [by, "v"]).join(places, [by, "rv"])
    nearest = F.struct(F.round(F.abs(F.log1p("v") - F.log1p("rv")), 9).alias("dv"), F.round(F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")), 6).alias("d"), F.col("route"))
    return pairs.groupBy("point").agg(F.min(nearest).alias("m")).select("point", F.col("m.route").alias("route"), F.col("m.dv").alias("volume_gap"), F.col("m.d").alias("distance"))


def resample(points: DataFrame, key: str, t: str, value: str, step: int) -> DataFrame:
    """key, t, value on the grid of multiples of ``step`` between the first and last point of each key, linearly between neighbours.

    Every point sends its segment to the next one onto the grid, so a key of any length stays spread over
    its points. Of points of one time the mean counts.
    """
    rows = points.where(F.col(t).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), F.col(t).cast("long").alias("t0")).agg(F.avg(value).alias("v0"))
    order = Window.partitionBy("k").orderBy("t0")
    rows = rows.withColumn("t1", F.lead("t0").over(order)).withColumn("v1", F.lead("v0").over(order))
    first, last = F.ceil(F.col("t0") / step) * step, F.coalesce(F.col("t1") - 1, F.col("t0"))
    grid = rows.where(first <= last).withColumn("t", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))))
    between = F.col("v0") + F.coalesce((F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")), F.lit(0.0))
    return grid.select(F.col("k").alias(key), "t", between.alias("value"))


def spline_basis(tau: np.ndarray, n: int, degree: int = 3) -> np.ndarray:
    """Values (len(tau), n) of clamped B-splines over [0, 1], by the recursion over degrees."""
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n - degree + 1), np.ones(degree)])
    tau = np.clip(np.asarray(tau, float), 0, 1)
    basis = ((tau[:, None] >= knots[:-1]) & (tau[:, None] < knots[1:])).astype(float)
    basis[tau == 1, n - 1] = 1.0
    for d in range(1, degree + 1):
        for i in range(len(knots) - d - 1):
            left = knots[i + d] - knots[i]
            right = knots[i + d + 1] - knots[i + 1]
            a = (tau - knots[i]) / left * basis[:, i] if left > 0 else 0.0
            b = (knots[i + d + 1] - tau) / right * basis[:, i + 1] if right > 0 else 0.0
            basis[:, i] = a + b
    return basis[:, :n]


def spline_curve(samples: int):
    """Pandas UDF: control values (array of at least 4) as ``samples`` points of their cubic spline."""
    tau = np.linspace(0, 1, samples)

    @pandas_udf("array<double>")
    def curve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            out = []
            for values in batch:
                if values is None or len(values) < 4:
                    out.append(None)
                    continue
                basis = known.setdefault(len(values), spline_basis(tau, len(values)))
                out.append(np.round(basis @ np.asarray(values, float), 6).tolist())
            yield pd.Series(out)

    return curve


def top_classes(scores: Column, k: int) -> Column:
    """Softmax of map<label, score> as an array of struct(p, label), the k most likely first, ties by label."""
    most = F.array_max(F.map_values(scores))
    weights = F.transform(F.map_entries(scores), lambda e: F.struct(F.exp(e["value"] - most).alias("w"), e["key"].alias("label")))
    total = F.aggregate(weights, F.lit(0.0), lambda s, e: s + e["w"])
    ranked = F.array_sort(F.transform(weights, lambda e: F.struct((-F.round(e["w"] / total, 9)).alias("p"), e["label"].alias("label"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct((-e["p"]).alias("p"), e["label"].alias("label")))
