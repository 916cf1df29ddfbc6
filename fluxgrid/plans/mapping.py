"""Queries that map documents to tags with a trace, articles to sections, and chunks to what the index holds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import chat, layout, tagging
from fluxgrid.plans.chat import ROWS
from fluxgrid.plans.registry import query
from fluxgrid.plans.text import LINES, _term, single_line_sql
from fluxgrid.sources.tables import read_table


def _value(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else f"'{x}'"


_LINKED = {cause: (relation, process, defect) for relation, cause, process, defect in tagging.RELATIONS}
_TERMS = [(f"{kind}:{tag}", kind, tag if kind == "process" else None, tag if kind == "defect" else None, term) for kind, tag, terms in tagging.RULES for term in terms if term not in tagging.DISABLED]
_TERMS += [(f"{cause}:{_LINKED[cause][0]}", "cause", *_LINKED[cause][1:], term) for cause, terms in tagging.CAUSES.items() for term in terms if term not in tagging.DISABLED]
TRACE = "WITH low AS (SELECT doc_id AS key, source, lower(coalesce(title, '')) AS title, lower(coalesce(text, '')) AS text FROM documents WHERE trim(lower(coalesce(title, '')), ' ') NOT IN ({})), f AS ({} UNION ALL {} UNION ALL {})".format(
    ", ".join(_value(t) for t in tagging.EXCLUDED),
    " UNION ALL ".join(f"SELECT key, '{rule}' AS rule, '{category}' AS category, {_value(process)} AS process, {_value(defect)} AS defect, NULL::VARCHAR AS role, '{term}' AS term, CASE WHEN {_term('title', term)} THEN 'title' ELSE 'text' END AS matched_in FROM low WHERE {_term('title', term)} OR {_term('text', term)}" for rule, category, process, defect, term in _TERMS),
    " UNION ALL ".join(f"SELECT key, '{rule}', 'section', {_value(process)}, NULL, {_value(role)}, '{words}', 'section' FROM low WHERE source = '{source}' AND {_term('title', words)}" for rule, source, words, process, role in tagging.SECTIONS),
    "SELECT key, 'default:' || source, 'default', NULL, NULL, role, source, 'source' FROM low JOIN (SELECT DISTINCT source_id AS source, unnest(evidence_roles) AS role FROM source_spec) USING (source)",
)
_LISTED = "array_to_string(list_filter([{}], lambda t: list_contains({{}}, t)), ',')".format(", ".join(f"'{t}'" for t in tagging.ORDER))
MAPPED = TRACE + f""", g AS (SELECT key, count(*) AS n, list(DISTINCT process) FILTER (process IS NOT NULL) AS p, list(DISTINCT defect) FILTER (defect IS NOT NULL) AS d, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM f GROUP BY key),
    mapped AS (SELECT doc_id, source, lower(trim(coalesce(title, ''), ' ')) IN ({', '.join(_value(t) for t in tagging.EXCLUDED)}) AS excluded, coalesce({_LISTED.format('p')}, '') AS processes, coalesce({_LISTED.format('d')}, '') AS defects, coalesce(roles, '') AS roles, coalesce(n, 0) AS n_matches FROM documents LEFT JOIN g ON key = doc_id)"""


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source", "title", "text")


def _trace(spark: SparkSession, folder: str) -> DataFrame:
    sources = read_table(spark, folder, "source_spec").select(F.col("source_id").alias("source"), F.col("evidence_roles").alias("roles"))
    return tagging.trace(_texts(spark, folder), sources)


@query(TRACE + " SELECT key AS doc_id, rule, category, process, defect, role, term, matched_in FROM f")
def mapping_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that speaks for a document's tags: terms, causes through their relations, rules of sections, defaults of sources."""
    return _trace(spark, folder).withColumnRenamed("key", "doc_id")


@query(MAPPED + " SELECT doc_id, excluded, processes, defects, roles, n_matches FROM mapped")
def mapped_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's processes, defects and roles."""
    return tagging.mapped(_texts(spark, folder), _trace(spark, folder)).withColumnRenamed("key", "doc_id")


@query(MAPPED + """ SELECT coalesce(source, 'none') AS source, count(*) AS documents, count_if(excluded) AS excluded, count_if(processes <> '') AS with_process, count_if(defects <> '') AS with_defect,
    bool_and(NOT (excluded AND (n_matches > 0 OR roles <> '')) AND (n_matches > 0 OR processes || defects || roles = '')) AS sound FROM mapped GROUP BY ALL""")
def mapping_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Whether excluded documents have nothing and tags have a trace, by source."""
    rows = tagging.mapped(_texts(spark, folder), _trace(spark, folder)).join(_texts(spark, folder).select("key", "source"), "key")
    tags = F.concat("processes", "defects", "roles")
    sound = ~(F.col("excluded") & ((F.col("n_matches") > 0) | (F.col("roles") != ""))) & ((F.col("n_matches") > 0) | (tags == ""))
    return rows.groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("documents"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("processes") != "").alias("with_process"), F.count_if(F.col("defects") != "").alias("with_defect"), F.bool_and(sound).alias("sound"))


@query(TRACE + ", r AS (SELECT * FROM (VALUES {}) r(relation, cause, process, defect, strength)), c AS (SELECT rule, count(DISTINCT key) AS texts FROM f WHERE category = 'cause' GROUP BY rule)".format(", ".join(f"('{r}', '{c}', '{p}', '{d}', '{tagging.STRENGTHS[r]}')" for r, c, p, d in tagging.RELATIONS)) + """
    SELECT defect, row_number() OVER (PARTITION BY defect ORDER BY CASE strength WHEN 'strong' THEN 1 WHEN 'medium_strong' THEN 2 WHEN 'conditional' THEN 3 ELSE 99 END, relation)::INT AS rank, relation, cause, process, strength, coalesce(texts, 0) AS texts FROM r LEFT JOIN c ON c.rule = r.cause || ':' || r.relation""")
def cause_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Causes of each defect in order of strength, and the documents that name them."""
    return tagging.cause_candidates(_trace(spark, folder))


# Whole lines that stand outside an article.
FURNITURE = [r"\d{1,4}", "©.*", r"Was this page helpful\?.*", "Sponsored content .*"]
_UNITS = f"""WITH spec AS (SELECT DISTINCT source AS source_id, {single_line_sql('title')} AS t FROM documents WHERE trim(title, ' ') <> ''),
    l AS (SELECT line_id, page_id, source_id, line_no, {single_line_sql('text')} AS t FROM {LINES}),
    k AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_id, t ORDER BY line_no, line_id) AS nth, row_number() OVER (PARTITION BY source_id, page_id ORDER BY line_no, line_id) AS pos FROM l WHERE t <> '' AND NOT regexp_full_match(t, '{"|".join(FURNITURE)}')),
    h AS (SELECT k.*, spec.t IS NOT NULL AND nth = 1 AS head FROM k LEFT JOIN spec ON spec.source_id = k.source_id AND spec.t = k.t),
    w AS (SELECT *, max(CASE WHEN head THEN pos END) OVER (PARTITION BY source_id, page_id ORDER BY pos) AS near, count_if(head) OVER (PARTITION BY source_id ORDER BY TRY_CAST(regexp_extract(page_id, '(\\d+)$', 1) AS BIGINT), page_id, pos) AS section_no FROM h),
    x AS (SELECT *, coalesce(pos - near <= 1, false) AS title FROM w),
    y AS (SELECT *, head OR pos = 1 OR (NOT title AND lag(title) OVER (PARTITION BY source_id, page_id ORDER BY pos)) AS begins FROM x),
    z AS (SELECT *, count_if(begins) OVER (PARTITION BY source_id, page_id ORDER BY pos) AS unit_no FROM y)
    SELECT page_id, source_id, max(section_no) AS section_no, unit_no, CASE WHEN bool_or(title) THEN 'title' ELSE 'text' END AS kind, count(*) AS lines, sha256(string_agg(t, chr(10) ORDER BY pos)) AS text_hash FROM z GROUP BY page_id, source_id, unit_no"""


@query(_UNITS)
def article_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Pages read as articles: the titles of a source's documents begin sections, with the line below them."""
    titles = read_table(spark, folder, "documents").where("trim(title) <> ''").select(F.col("source").alias("source_id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("marker")).distinct()
    headings = titles.withColumn("occurrence", F.lit(1)).withColumn("following", F.lit(1))
    units = layout.article_units(read_table(spark, folder, "layout_line"), headings, FURNITURE)
    return units.withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query("""SELECT DISTINCT chunk_id, q.source_id, pdf_page_start::BIGINT AS first_page, pdf_page_end::BIGINT AS last_page, s.title, coalesce(s.organization, '') AS organization, s.document_type, s.language, array_to_string(s.evidence_roles, ',') AS roles, s.rights_status AS rights, q.semantic_tag_excluded AS excluded, s.source_id IS NOT NULL AS known
    FROM qdrant_input q LEFT JOIN (SELECT DISTINCT * FROM source_spec) s USING (source_id)""")
def index_payload(spark: SparkSession, folder: str) -> DataFrame:
    """What the index holds of each chunk beside its vector, from the chunk and its source."""
    sources = read_table(spark, folder, "source_spec").select("source_id", "title", "organization", "document_type", "language", "evidence_roles", "rights_status").distinct().withColumn("known", F.lit(True))
    rows = read_table(spark, folder, "qdrant_input").select("chunk_id", "source_id", "pdf_page_start", "pdf_page_end", "semantic_tag_excluded").distinct().join(sources, "source_id", "left")
    return rows.select(
        "chunk_id", "source_id", F.col("pdf_page_start").cast("long").alias("first_page"), F.col("pdf_page_end").cast("long").alias("last_page"), "title", F.coalesce("organization", F.lit("")).alias("organization"), "document_type", "language",
        F.array_join("evidence_roles", ",").alias("roles"), F.col("rights_status").alias("rights"), F.col("semantic_tag_excluded").alias("excluded"), F.coalesce("known", F.lit(False)).alias("known"),
    )


@query("""WITH r AS (SELECT DISTINCT query_id, gold_sources FROM retriever_main), g AS (SELECT query_id, unnest(list_distinct(gold_sources)) AS source_id FROM r), s AS (SELECT source_id, bool_or(enabled) AS enabled FROM source_spec GROUP BY 1)
    SELECT r.query_id, count(g.source_id) AS asked, count(*) FILTER (s.enabled) AS enabled, count_if(g.source_id IS NOT NULL AND NOT coalesce(s.enabled, false)) AS refused, count_if(g.source_id IS NOT NULL AND NOT coalesce(s.enabled, false)) = 0 AS valid
    FROM (SELECT DISTINCT query_id FROM r) r LEFT JOIN (SELECT DISTINCT * FROM g) g USING (query_id) LEFT JOIN s USING (source_id) GROUP BY r.query_id""")
def request_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that each question names, against those that are enabled; a request with others is refused."""
    rows = read_table(spark, folder, "retriever_main").select("query_id", "gold_sources").distinct()
    enabled = read_table(spark, folder, "source_spec").groupBy("source_id").agg(F.bool_or("enabled").alias("on"))
    asked = rows.select("query_id", F.explode_outer("gold_sources").alias("source_id")).distinct().join(enabled, "source_id", "left")
    named, on = F.col("source_id").isNotNull(), F.coalesce("on", F.lit(False))
    out = asked.groupBy("query_id").agg(F.count_if(named).alias("asked"), F.count_if(named & on).alias("enabled"), F.count_if(named & ~on).alias("refused"))
    return out.withColumn("valid", F.col("refused") == 0)


@query(f"""WITH r AS (SELECT conversation, list(lower(trim(role, ' ')) ORDER BY row_id) AS roles FROM {ROWS} GROUP BY conversation), m AS (SELECT conversation, lower(trim(role, ' ')) AS role, count(*) AS n FROM {ROWS} GROUP BY ALL),
    s AS (SELECT conversation, sum(n) AS actual, sum(least(n, CASE WHEN role IN ('user', 'assistant') THEN 1 ELSE 0 END)) AS matched FROM m GROUP BY conversation)
    SELECT count(*) AS conversations, round(avg(2.0 * matched / (actual + 2)), 6) AS f1, round(count_if(roles = ['user', 'assistant']) / count(*), 6) AS exact FROM s JOIN r USING (conversation)""")
def sequence_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of all conversations against one question and one answer: mean F1 of the multisets, and the share in just that order."""
    messages, expected = read_table(spark, folder, "messages"), ["user", "assistant"]
    return chat.sequence_summary(messages, expected)
