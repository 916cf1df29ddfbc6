"""Queries over the property graph of the evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import graphs
from fluxgrid.plans.registry import query
from fluxgrid.sources.tables import read_table

GRAPH = """WITH q AS (SELECT DISTINCT * FROM retriever_main), d AS (SELECT query_id, unnest(defect_ids) AS x FROM q), p AS (SELECT query_id, unnest(process_ids) AS x FROM q), g AS (SELECT DISTINCT query_id, unnest(gold_sources) AS x FROM q),
    nodes AS (SELECT label, identity, max(name) AS name FROM (SELECT 'Question' AS label, query_id AS identity, query_type AS name FROM q UNION ALL SELECT 'Defect', x, replace(x, '_', ' ') FROM d UNION ALL SELECT 'Process', x, x FROM p
        UNION ALL SELECT 'Source', source_id, title FROM source_spec UNION ALL SELECT 'Organization', organization, organization FROM source_spec WHERE organization IS NOT NULL) WHERE identity IS NOT NULL GROUP BY ALL),
    edges AS (SELECT DISTINCT * FROM (SELECT 'ASKS_ABOUT' AS type, 'Question' AS from_label, query_id AS from_id, 'Defect' AS to_label, x AS to_id FROM d UNION ALL SELECT 'SUSPECTS', 'Question', query_id, 'Process', x FROM p
        UNION ALL SELECT 'ANSWERED_BY', 'Question', query_id, 'Source', x FROM g UNION ALL SELECT 'PUBLISHED_BY', 'Source', source_id, 'Organization', organization FROM source_spec) WHERE from_id IS NOT NULL AND to_id IS NOT NULL)"""


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return graphs.property_graph(read_table(spark, folder, "retriever_main"), read_table(spark, folder, "source_spec"))


@query(GRAPH + " SELECT * FROM nodes")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[0]


@query(GRAPH + " SELECT * FROM edges")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)[1]


@query(GRAPH + " SELECT 'node' AS part, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type")
def graph_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes by label and edges by type."""
    nodes, edges = _graph(spark, folder)
    n = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "name", "n")
    e = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "name", "n")
    return n.unionByName(e)


@query(GRAPH + """ SELECT a.to_id AS defect, s.to_id AS process, o.to_id AS organization, count(DISTINCT a.from_id) AS questions, count(DISTINCT w.to_id) AS sources FROM edges a JOIN edges s ON s.type = 'SUSPECTS' AND s.from_id = a.from_id
    JOIN edges w ON w.type = 'ANSWERED_BY' AND w.from_id = a.from_id LEFT JOIN edges o ON o.type = 'PUBLISHED_BY' AND o.from_id = w.to_id WHERE a.type = 'ASKS_ABOUT' GROUP BY ALL""")
def cause_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths from a defect over its questions to processes, and on to sources and their publishers, if any."""
    return graphs.cause_paths(_graph(spark, folder)[1])


@query(GRAPH + """ SELECT to_id AS process, count(DISTINCT from_id) AS questions, string_agg(DISTINCT d, ',' ORDER BY d) AS defects FROM (SELECT s.to_id, s.from_id, a.to_id AS d FROM edges s JOIN edges a ON a.type = 'ASKS_ABOUT' AND a.from_id = s.from_id WHERE s.type = 'SUSPECTS') GROUP BY to_id""")
def process_defects(spark: SparkSession, folder: str) -> DataFrame:
    """Each process with the defects that are asked about together with it."""
    edges = _graph(spark, folder)[1]
    both = graphs.hop(edges.where("type = 'SUSPECTS'").select(F.col("from_id").alias("question"), F.col("to_id").alias("process")), edges, "ASKS_ABOUT", "question", "defect")
    return both.groupBy("process").agg(F.countDistinct("question").alias("questions"), F.array_join(F.sort_array(F.collect_set("defect")), ",").alias("defects"))


@query(GRAPH + """, u AS (SELECT from_id AS a, to_id AS b FROM edges WHERE type IN ('ANSWERED_BY', 'PUBLISHED_BY')), l AS (SELECT identity AS node FROM nodes WHERE label IN ('Question', 'Source', 'Organization')),
    w AS (SELECT a, b FROM u UNION SELECT b, a FROM u) SELECT count(*) AS nodes, count_if(node NOT IN (SELECT a FROM w)) AS alone FROM l""")
def graph_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of questions, sources and publishers, and how many of them are in a component of their own."""
    nodes, edges = _graph(spark, folder)
    nodes = nodes.where(F.col("label").isin("Question", "Source", "Organization"))
    ways = edges.where(F.col("type").isin("ANSWERED_BY", "PUBLISHED_BY"))
    found = graphs.connected_components(nodes, ways, "identity", "from_id", "to_id")
    sizes = found.groupBy("component").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") == 1).alias("alone"))


@query(GRAPH.replace("WITH", "WITH RECURSIVE", 1) + """, u AS (SELECT from_id AS a, to_id AS b FROM edges WHERE type IN ('ANSWERED_BY', 'PUBLISHED_BY')), w AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
    l AS (SELECT DISTINCT identity AS x FROM nodes WHERE label IN ('Question', 'Source', 'Organization')), r AS (SELECT x, x AS y FROM l UNION SELECT r.x, w.b FROM r JOIN w ON w.a = r.y) SELECT x AS identity, min(y) AS component FROM r GROUP BY x""")
def graph_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components of questions, sources and publishers that answers connect."""
    nodes, edges = _graph(spark, folder)
    nodes = nodes.where(F.col("label").isin("Question", "Source", "Organization"))
    return graphs.connected_components(nodes, edges.where(F.col("type").isin("ANSWERED_BY", "PUBLISHED_BY")), "identity", "from_id", "to_id")


@query("""WITH d AS (SELECT DISTINCT chunk_id, source_id, pdf_page_start, pdf_page_end, semantic_tag_excluded, array_to_string(list_transform(embedding, lambda x: CASE WHEN x IS NULL THEN 'null' WHEN isnan(x) THEN 'nan' ELSE floor(x::DOUBLE * 1099511627776)::BIGINT::VARCHAR END), ',') AS vector FROM qdrant_input),
    h AS (SELECT sha256(concat_ws(chr(31), chunk_id, source_id, coalesce(pdf_page_start::VARCHAR, chr(0)), coalesce(pdf_page_end::VARCHAR, chr(0)), coalesce(semantic_tag_excluded::VARCHAR, chr(0)), coalesce(vector, chr(0)))) AS h FROM d),
    p AS (SELECT substr(h, 1, 2) AS r, count(*) AS n, sum(('0x' || substr(h, 3, 15))::BIGINT::HUGEINT) AS s, sum(('0x' || substr(h, 18, 15))::BIGINT::HUGEINT) AS t FROM h GROUP BY r)
    SELECT sum(n)::BIGINT AS n_rows, sha256(string_agg(r || ':' || n || ':' || s || ':' || t, '|' ORDER BY r || ':' || n || ':' || s || ':' || t)) AS fingerprint FROM p""")
def index_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """A fingerprint of the index, payload and vectors, that doesn't depend on the order of rows."""
    columns = ["chunk_id", "source_id", "pdf_page_start", "pdf_page_end", "semantic_tag_excluded"]
    rows = read_table(spark, folder, "qdrant_input").select(*columns, graphs.exact_text("embedding").alias("vector")).distinct()
    return graphs.fingerprint(rows, [*columns, "vector"])
