"""Sources mixed to target weights (problem 7).

Capped water-filling: every source gets budget in proportion to its weight, a source that would have to be
repeated more often than allowed is clamped at its cap, and the excess goes to the others in proportion
until all is feasible. Sorted by cap per weight, the clamped sources are a prefix, so running sums find the
fixed point of that redistribution at once. Whole repetitions take every document, the fractional one takes
documents in the order of a seeded hash until its share is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.sources.scratch import cut

#: Ranges of the hash by which a source's documents are summed up before they are ordered.
RANGES = 4_096


def water_fill(sources: DataFrame, budget: float | None = None) -> DataFrame:
    """``sources`` (source_id, target_share, max_repeats, size) with cap, granted, clamped.

    ``granted`` sums up to ``budget``, by default the size of all sources, or to all caps where those are
    less. The table has one row per wanted source; it is small by its nature.
    """
    rows = sources.withColumn("cap", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)) * F.coalesce("size", F.lit(0)).cast("double")).withColumn("weight", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)))
    total = F.lit(float(budget)) if budget is not None else F.sum(F.coalesce("size", F.lit(0))).over(Window.partitionBy()).cast("double")
    order = Window.partitionBy(F.lit(0)).orderBy(F.try_divide("cap", "weight"), "source_id")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", total)
    some = rows.where("weight > 0").withColumn("level", F.try_divide(F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(after)))
    some = some.withColumn("nth", F.row_number().over(order))
    # The level rises as long as clamping goes on; at the first source under its cap it is the level of all others.
    first = F.min(F.when(F.col("weight") * F.col("level") < F.col("cap"), F.struct("nth", "level")))
    some = some.withColumn("water", first.over(Window.partitionBy(F.lit(0))).getField("level"))
    some = some.withColumn("clamped", F.col("water").isNull() | (F.col("cap") <= F.col("weight") * F.col("water")))
    some = some.withColumn("granted", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("water")))
    none = rows.where("weight = 0").withColumn("clamped", F.lit(False)).withColumn("granted", F.lit(0.0))
    columns = [*sources.columns, "cap", "granted", "clamped"]
    return some.select(*columns).unionByName(none.select(*columns))


def mix(documents: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) for documents (doc_id, source, tokens) and targets (source_id, target_share, max_repeats).

    chosen: doc_id, source_id, tokens, repeats of every document that is used; a document is used at most
    max_repeats times. shares: source_id, target_share, max_repeats, documents, size, granted, clamped,
    actual, actual_share. Documents of no or an unlisted source aren't used, listed sources without
    documents get nothing and their share goes to the others. Null shares and repeats count as 0, repeated
    rows once.
    """
    wanted = targets.where("source_id IS NOT NULL").groupBy("source_id").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = documents.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct(F.col("source").alias("source_id"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))).alias("r")).select("doc_id", "r.*")
    rows = cut(rows.join(wanted.select("source_id"), "source_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(seed))), "documents")
    sizes = rows.groupBy("source_id").agg(F.count("*").alias("documents"), F.sum("tokens").alias("size"))
    plan = wanted.join(sizes, "source_id", "left").na.fill(0, ["documents", "size"])
    plan = cut(water_fill(plan, budget), "plan")
    epochs = plan.where("size > 0").withColumn("whole", F.when(F.col("clamped"), F.col("max_repeats")).otherwise(F.floor(F.try_divide("granted", "size"))).cast("int"))
    epochs = epochs.select("source_id", "whole", F.when(F.col("clamped"), F.lit(0.0)).otherwise(F.col("granted") - F.col("whole") * F.col("size")).alias("rest"))
    # Running sums in hash order, by ranges of the hash first: no source is ever sorted in one task.
    rows = rows.withColumn("range", F.pmod(F.shiftright("h", 40), F.lit(RANGES)))
    ranges = rows.groupBy("source_id", "range").agg(F.sum("tokens").alias("tokens"))
    below = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_id", "range", F.coalesce(F.sum("tokens").over(below), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_id", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(ranges, ["source_id", "range"]).join(epochs, "source_id")
    more = F.col("base") + F.col("ahead") + F.col("tokens") / 2 < F.col("rest")
    chosen = rows.withColumn("repeats", F.col("whole") + F.when(more, 1).otherwise(0)).where("repeats > 0").select("doc_id", "source_id", "tokens", "repeats")
    actual = chosen.groupBy("source_id").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual"))
    shares = plan.join(actual, "source_id", "left").na.fill(0, ["actual"])
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual"), F.sum("actual").over(Window.partitionBy())), F.lit(0.0)))
    return chosen, shares.select("source_id", "target_share", "max_repeats", "documents", "size", "granted", "clamped", "actual", "actual_share")
