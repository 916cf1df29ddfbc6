"""Queries over numeric profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import series
from fluxgrid.plans.registry import query
from fluxgrid.sources.tables import read_table

LIMITS = {"l_quantity": (5.0, 45.0), "l_discount": (0.0, 0.08), "l_tax": (0.0, 0.07)}
INDEX = {c: f"abs({c} - {(a + b) / 2!r}) / {(b - a) / 2!r} * 100" for c, (a, b) in LIMITS.items()}


@query(f"SELECT l_orderkey, l_linenumber, round(greatest({', '.join(INDEX.values())}), 6) AS worst, round(greatest({', '.join(INDEX.values())}), 2) <= 100 AS qualified FROM lineitem")
def window_scores(spark: SparkSession, folder: str) -> DataFrame:
    """How far each line's measures are from the middle of their windows."""
    rows = series.worst_window(read_table(spark, folder, "lineitem"), LIMITS)
    return rows.select("l_orderkey", "l_linenumber", F.round("worst", 6).alias("worst"), "qualified")


@query(f"""SELECT l_orderkey, bool_and(round(worst, 2) <= 100) AS qualified, arg_max(l_linenumber, struct_pack(w := round(worst, 9), n := -l_linenumber)) AS worst_line, round(max(worst), 6) AS worst
    FROM (SELECT *, greatest({', '.join(INDEX.values())}) AS worst FROM lineitem) GROUP BY l_orderkey""")
def window_overall(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's worst line, the first of equals, and whether all its lines qualify."""
    rows = series.worst_window(read_table(spark, folder, "lineitem"), LIMITS)
    worst = F.max_by("l_linenumber", F.struct(F.round("worst", 9).alias("w"), (-F.col("l_linenumber")).alias("n")))
    return rows.groupBy("l_orderkey").agg(F.bool_and("qualified").alias("qualified"), worst.alias("worst_line"), F.round(F.max("worst"), 6).alias("worst"))


BOUNDS = {"l_quantity": (1.0, 40.0), "l_extendedprice": (1000.0, 60000.0), "l_discount": (0.0, 0.07)}


@query("SELECT l_orderkey, l_linenumber, concat_ws(',', {}) AS outside FROM lineitem".format(", ".join(f"CASE WHEN NOT coalesce({c} BETWEEN {a} AND {b}, false) THEN '{c}' END" for c, (a, b) in BOUNDS.items())))
def domain_check(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of each line that lie outside their training domain."""
    return read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", series.outside(BOUNDS).alias("outside"))


@query("""WITH v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, len(q) AS n, coalesce(list_bool_and(list_transform(range(1, len(q)), lambda i: q[i + 1] - q[i] >= -1e-12)), true) AS rising, round(coalesce(list_sum(list_transform(range(1, len(q)), lambda i: pow(greatest(q[i] - q[i + 1], 0.0), 2))), 0), 6) AS falls FROM v""")
def monotone_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether an order's quantities never fall from line to line, and by how much they do."""
    item = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    rows = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(item.alias("items")).withColumn("q", F.col("items.l_quantity"))
    return rows.select("l_orderkey", F.size("q").alias("n"), series.rising(F.col("q")).alias("rising"), F.round(series.falls(F.col("q")), 6).alias("falls"))


@query("""WITH p AS (SELECT c_custkey AS point, c_nationkey AS nation, (c_custkey % 100)::DOUBLE AS x, (c_custkey % 37)::DOUBLE AS y, abs(c_acctbal) AS v FROM customer), r AS (SELECT s_suppkey AS route, s_nationkey AS nation, (s_suppkey % 100)::DOUBLE AS rx, (s_suppkey % 37)::DOUBLE AS ry, abs(s_acctbal) AS rv FROM supplier),
    d AS (SELECT point, route, round(abs(ln(1 + v) - ln(1 + rv)), 9) AS volume_gap, round(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)), 6) AS distance FROM p JOIN r USING (nation))
    SELECT point, route, round(volume_gap, 6) AS volume_gap, distance FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY volume_gap, distance, route) AS n FROM d) WHERE n = 1""")
def nearest_route(spark: SparkSession, folder: str) -> DataFrame:
    """The supplier of its nation that is nearest to each customer: by volume, then by place, then by key."""
    c, s = read_table(spark, folder, "customer"), read_table(spark, folder, "supplier")
    place = lambda key, a, b: [(F.col(key) % 100).cast("double").alias(a), (F.col(key) % 37).cast("double").alias(b)]
    points = c.select(F.col("c_custkey").alias("point"), F.col("c_nationkey").alias("nation"), *place("c_custkey", "x", "y"), F.abs("c_acctbal").alias("v"))
    routes = s.select(F.col("s_suppkey").alias("route"), F.col("s_nationkey").alias("nation"), *place("s_suppkey", "rx", "ry"), F.abs("s_acctbal").alias("rv"))
    return series.nearest_route(points, routes, "nation").withColumn("volume_gap", F.round("volume_gap", 6))


@query("""WITH p AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t0, avg(value) AS v0 FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL),
    s AS (SELECT *, lead(t0) OVER w AS t1, lead(v0) OVER w AS v1 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t0)),
    g AS (SELECT *, unnest(range((ceil(t0 / 21600.0) * 21600)::BIGINT, coalesce(t1, t0 + 1), 21600)) AS t FROM s)
    SELECT user_id, t, round(v0 + coalesce((v1 - v0) * (t - t0) / (t1 - t0), 0), 4) AS value FROM g""")
def curve_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's values on a grid of six hours."""
    rows = read_table(spark, folder, "events").withColumn("t", F.unix_timestamp("ts"))
    return series.resample(rows, "user_id", "t", "value", 21_600).withColumn("value", F.round("value", 4))


@query()
def spline_curves(spark: SparkSession, folder: str) -> DataFrame:
    """Smooth curves through the control of each user's daily means."""
    days = read_table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    control = days.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("day", "v"))).alias("s")).select("user_id", F.col("s.v").alias("control"))
    return control.select("user_id", F.posexplode(series.spline_curve(25)("control")).alias("i", "value"))


@query("""WITH s AS (SELECT user_id, event_type AS label, round(avg(value) / 10, 6) AS score FROM events GROUP BY ALL), w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY user_id)) AS w FROM s),
    p AS (SELECT user_id, label, round(w / sum(w) OVER (PARTITION BY user_id), 9) AS p FROM w)
    SELECT user_id, label, round(p, 6) AS p, n::INT AS rank, CASE WHEN p < 0.6 THEN 'manual_review' ELSE 'accepted' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, label) AS n FROM p) WHERE n <= 2""")
def softmax_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The two likeliest event types of each user; below 0.6 they need a look."""
    scores = read_table(spark, folder, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value") / 10, 6).alias("score"))
    maps = scores.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "score"))).alias("scores"))
    rows = maps.select("user_id", F.posexplode(series.top_classes(F.col("scores"), 2)).alias("i", "c"))
    return rows.select("user_id", "c.label", F.round("c.p", 6).alias("p"), (F.col("i") + 1).alias("rank"), F.when(F.col("c.p") < 0.6, "manual_review").otherwise("accepted").alias("state"))
