"""Connected components of an undirected graph, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.sources.scratch import cut


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node that a path of ``edges`` reaches.

    Edges are undirected; repeated edges, loops and edges to unknown nodes change nothing. Labels are
    lowered along edges and then along labels until none changes, so a path of length n takes about log n
    rounds. Null nodes are left out; empty inputs give an empty result.
    """
    labels = nodes.select(F.col(node).alias("node")).where("node IS NOT NULL").distinct().withColumn("component", F.col("node"))
    ways = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ways = ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    known = labels.select(F.col("node").alias("b"))
    ways = cut(ways.join(known, "b", "left_semi"), "edges")
    labels = cut(labels, "labels")
    if ways.isEmpty():
        return labels.withColumnRenamed("node", node)
    while True:
        near = ways.join(labels.select(F.col("node").alias("b"), F.col("component").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", "component", F.least("component", F.coalesce("other", "component")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        lower = cut(lower.join(jump, "next").select("node", "component", F.least("next", "far").alias("next")), "labels")
        done = lower.where("next <> component").isEmpty()
        labels = lower.select("node", F.col("next").alias("component"))
        if done:
            return labels.withColumnRenamed("node", node)


def property_graph(questions: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the question set: label, identity, name; type, from_label, from_id, to_label, to_id.

    Questions point to the defects they ask about and the processes they suspect, to the sources that answer
    them; sources point to their publisher. Keys are unique: repeated rows merge, the last name in order wins.
    """
    q = questions.dropDuplicates(["query_id"])
    part = lambda label, ident, name: lambda df: df.select(F.lit(label).alias("label"), ident.alias("identity"), name.alias("name"))
    defects, processes = q.select("query_id", F.explode("defect_ids").alias("x")), q.select("query_id", F.explode("process_ids").alias("x"))
    gold = q.select("query_id", F.explode(F.array_distinct("gold_sources")).alias("x"))
    nodes = [
        part("Question", F.col("query_id"), F.col("query_type"))(q), part("Defect", F.col("x"), F.replace("x", F.lit("_"), F.lit(" ")))(defects), part("Process", F.col("x"), F.col("x"))(processes),
        part("Source", F.col("source_id"), F.col("title"))(sources), part("Organization", F.col("organization"), F.col("organization"))(sources.where("organization IS NOT NULL")),
    ]
    nodes = _union(nodes).where("identity IS NOT NULL").groupBy("label", "identity").agg(F.max("name").alias("name"))
    link = lambda kind, a, ai, b, bi: lambda df: df.select(F.lit(kind).alias("type"), F.lit(a).alias("from_label"), ai.alias("from_id"), F.lit(b).alias("to_label"), bi.alias("to_id"))
    edges = [
        link("ASKS_ABOUT", "Question", F.col("query_id"), "Defect", F.col("x"))(defects), link("SUSPECTS", "Question", F.col("query_id"), "Process", F.col("x"))(processes),
        link("ANSWERED_BY", "Question", F.col("query_id"), "Source", F.col("x"))(gold), link("PUBLISHED_BY", "Source", F.col("source_id"), "Organization", F.col("organization"))(sources),
    ]
    edges = _union(edges).where("from_id IS NOT NULL AND to_id IS NOT NULL").distinct()
    return nodes, edges


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hop(paths: DataFrame, edges: DataFrame, kind: str, start: str, end: str, backward: bool = False, optional: bool = False) -> DataFrame:
    """``paths`` extended by one edge of a type from column ``start`` to a new column ``end``."""
    a, b = ("to_id", "from_id") if backward else ("from_id", "to_id")
    step = edges.where(F.col("type") == kind).select(F.col(a).alias(start), F.col(b).alias(end))
    return paths.join(step, start, "left" if optional else "inner")


def cause_paths(edges: DataFrame) -> DataFrame:
    """defect, process, organization, questions, sources: Defect <- Question -> Process, -> Source, -> Organization if any.

    A multi-hop path query: two inner hops from the question, then an optional one; paths are counted by
    their ends.
    """
    start = edges.where("type = 'ASKS_ABOUT'").select(F.col("to_id").alias("defect"), F.col("from_id").alias("question"))
    paths = hop(hop(start, edges, "SUSPECTS", "question", "process"), edges, "ANSWERED_BY", "question", "source")
    paths = hop(paths, edges, "PUBLISHED_BY", "source", "organization", optional=True)
    return paths.groupBy("defect", "process", "organization").agg(F.countDistinct("question").alias("questions"), F.countDistinct("source").alias("sources"))


def exact_text(vector: str) -> Column:
    """A vector of floats as text: whole numbers of 2 to the power of -40, so that equal values have equal texts."""
    value = lambda x: F.when(x.isNull(), "null").when(F.isnan(x), "nan").otherwise(F.floor(x.cast("double") * 2.0**40).cast("string"))
    return F.array_join(F.transform(vector, value), ",")


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows and fingerprint of a table, in no order: row hashes summed up by ranges of the hash, then chained.

    Whole tables never meet in one task: each of 256 ranges adds up its rows' hashes exactly (as decimals).
    """
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    parts = rows.select(h.alias("h")).groupBy(F.substring("h", 1, 2).alias("r"))
    half = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    parts = parts.agg(F.count("*").alias("n"), half(3).alias("s"), half(18).alias("t"))
    line = F.concat_ws(":", "r", *(F.col(c).cast("string") for c in "nst"))
    return parts.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("fingerprint"))
