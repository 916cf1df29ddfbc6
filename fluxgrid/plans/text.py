"""Queries over texts, layout lines and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx
from fluxgrid.operators import chunking, layout, tagging
from fluxgrid.plans.registry import query
from fluxgrid.sources.tables import read_table

P = tx.PATTERNS
B = tx.BLANKS
LINES = "(SELECT DISTINCT * FROM layout_line)"

NORMAL = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\x00', '', 'g'),
    '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '[{B}]*\\n[{B}]*', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[\\n{B}]+|[\\n{B}]+$', '', 'g')"""


def single_line_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\r\\n{B}]+', ' ', 'g'), ' ')"


@query(f"SELECT doc_id, sha256({NORMAL}) AS text_hash, length({NORMAL}) AS chars FROM documents")
def text_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in one form of white space: hash and length."""
    t = tx.normalize(F.col("text"))
    return read_table(spark, folder, "documents").select("doc_id", F.sha2(t, 256).alias("text_hash"), F.length(t).alias("chars"))


@query(f"SELECT doc_id, sha256({single_line_sql('text')}) AS line_hash FROM documents")
def single_line_hash(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", F.sha2(tx.single_line(F.col("text")), 256).alias("line_hash"))


@query("""
    WITH f AS (SELECT DISTINCT page_id, length(text) AS n, length(text) - length(replace(text, chr(65533), '')) AS r, regexp_matches(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]') AS c FROM ocr_result),
    g AS (SELECT page_id, concat_ws(',', CASE WHEN n = 0 THEN 'empty_text' WHEN n < 80 THEN 'low_text' END, CASE WHEN r / greatest(n, 1) > 0.01 THEN 'replacement_characters' END, CASE WHEN c THEN 'control_characters' END) AS flags FROM f)
    SELECT page_id, flags, CASE WHEN flags LIKE '%empty_text%' THEN 'fail' WHEN flags <> '' THEN 'warn' ELSE 'pass' END AS assessment FROM g""")
def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Flags and assessment of the text of each scanned page."""
    pages = read_table(spark, folder, "ocr_result").select("page_id", "text").distinct()
    flags = tx.quality_flags(F.col("text"))
    return pages.select("page_id", F.array_join(flags, ",").alias("flags"), tx.assessment(flags).alias("assessment"))


TYPED_SQL = f"""
    SELECT l.*, coalesce(font_size, 0) AS font, coalesce(median(CASE WHEN y1 > 0.08 AND y0 < 0.92 THEN font_size END) OVER (PARTITION BY page_id), median(font_size) OVER (PARTITION BY page_id), 0) AS typical, trim(text, ' ') AS t FROM {LINES} l WHERE trim(text, ' ') <> ''"""
_NUMBERED = "^\\d+(\\.\\d+){0,5}(\\s|[\\x{4E00}-\\x{9FFF}A-Za-z])"
TYPE_SQL = f"""CASE
    WHEN regexp_matches(t, '{P["page_number"]}') AND (y0 >= 0.88 OR y1 <= 0.12) THEN 'page_number'
    WHEN y1 <= 0.08 THEN 'header' WHEN y0 >= 0.92 THEN 'footer'
    WHEN regexp_matches(t, '{P["table_caption"]}') THEN 'table_caption' WHEN regexp_matches(t, '{P["figure_caption"]}') THEN 'figure_caption'
    WHEN regexp_matches(t, '{_NUMBERED}') OR regexp_matches(t, '{P["chapter"]}')
      OR (length(t) BETWEEN 4 AND 100 AND NOT contains(t, ' | ') AND x1 - x0 >= 0.12 AND typical > 0 AND font >= typical * 1.5 AND regexp_matches(t, '\\p{{L}}'))
      OR (length(t) BETWEEN 8 AND 100 AND regexp_matches(t, '^[^a-zäöüß]*$') AND regexp_matches(t, '[A-Z]{{2,}}[^A-Z]+(.*[^A-Z])?[A-Z]{{2,}}')) THEN 'heading'
    WHEN regexp_matches(t, '{P["list_item"]}') THEN 'list_item' WHEN contains(t, ' | ') THEN 'table'
    WHEN length(t) <= 160 AND regexp_matches(t, '{P["formula"]}') THEN 'formula' ELSE 'paragraph' END"""


@query(f"SELECT line_id, {TYPE_SQL} AS block_type FROM ({TYPED_SQL})")
def block_classify(spark: SparkSession, folder: str) -> DataFrame:
    """Kind of every layout line."""
    return layout.typed_lines(read_table(spark, folder, "layout_line")).select("line_id", "block_type")


@query(f"""
    WITH a AS (SELECT *, {TYPE_SQL} AS k FROM ({TYPED_SQL})),
    b AS (SELECT *, CASE WHEN k = lag(k) OVER w AND k IN ('paragraph', 'table') AND y0 - lag(y1) OVER w <= 0.035 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY page_id ORDER BY line_no, line_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY line_no, line_id) - 1 AS block_no FROM b)
    SELECT page_id, block_no::BIGINT AS block_no, min(k) AS block_type, count(*) AS lines, min(y0) AS y0, max(y1) AS y1, sha256(CASE WHEN min(k) = 'paragraph' THEN list_reduce(list(text ORDER BY line_no, line_id), lambda s, x: CASE WHEN s LIKE '%-' AND regexp_matches(x, '^[a-zäöüß]') THEN s[:-2] || x
        WHEN regexp_matches(s, '[，。；：！？、,.!?;:]$') OR regexp_matches(x, '^[)）,.]') THEN s || x ELSE s || ' ' || x END) ELSE string_agg(text, chr(10) ORDER BY line_no, line_id) END) AS text_hash FROM c GROUP BY page_id, block_no""")
def block_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent lines of one kind as blocks."""
    runs = layout.block_runs(layout.typed_lines(read_table(spark, folder, "layout_line")))
    return runs.select("page_id", "block_no", "block_type", "lines", "y0", "y1", F.sha2("text", 256).alias("text_hash"))


HEADING_SQL = f"""
    WITH l AS (SELECT line_id, {single_line_sql('text')} AS t FROM {LINES}),
    m AS (SELECT *, regexp_extract(t, '^([1-9]\\d*(\\.\\d+){{0,5}})(\\s*)(.+)$', 1) AS num, regexp_extract(t, '^([1-9]\\d*(\\.\\d+){{0,5}})(\\s*)(.+)$', 3) AS gap, regexp_extract(t, '^([1-9]\\d*(\\.\\d+){{0,5}})(\\s*)(.+)$', 4) AS title,
        length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters, length(regexp_replace(t, '[\\p{{L}}\\s]', '', 'g')) AS others, length(regexp_replace(t, '\\s', '', 'g')) AS shown FROM l),
    r AS (SELECT *, CASE WHEN length(t) < 3 THEN 'too_short' WHEN length(t) > 100 THEN 'too_long' WHEN contains(t, '|') THEN 'table_row' WHEN regexp_matches(t, '{P["leader"]}') THEN 'toc_entry'
        WHEN regexp_matches(t, '{P["label"]}') THEN 'generic_label' WHEN regexp_matches(t, '{P["list_sentence"]}') THEN 'list_sentence' WHEN regexp_matches(t, '{P["unit"]}') THEN 'parameter_expression'
        WHEN regexp_matches(t, '{P["sentence_end"]}') THEN 'sentence'
        WHEN num <> '' AND (TRY_CAST(regexp_extract(num, '^\\d+') AS BIGINT) > 99 OR NOT regexp_matches(title, '^\\p{{L}}') OR (gap = '' AND regexp_matches(title, '^[A-Za-z]'))) THEN 'numeric_noise'
        WHEN num <> '' AND regexp_matches(title, '^[a-z]') THEN 'sentence' WHEN num <> '' THEN 'numbered_heading'
        WHEN regexp_matches(t, '{P["chapter"]}') OR regexp_matches(t, '{P["appendix"]}') THEN 'named_heading' WHEN letters < 2 THEN 'insufficient_letters' WHEN others > 0.35 * length(t) THEN 'numeric_noise' ELSE 'unnumbered_heading' END AS reason FROM m)
    SELECT line_id, reason LIKE '%_heading' AS accepted, CASE reason WHEN 'numbered_heading' THEN least(length(num) - length(replace(num, '.', '')) + 1, 6) WHEN 'named_heading' THEN 1 WHEN 'unnumbered_heading' THEN 1 END::INT AS level, reason FROM r"""


@query(HEADING_SQL)
def heading_decision(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each layout line could be a heading, of which level, and why."""
    lines = read_table(spark, folder, "layout_line").dropDuplicates(["line_id"])
    return lines.select("line_id", tx.heading(F.col("text")).alias("h")).select("line_id", "h.*")


_MARKS = ", ".join(f"last_value(CASE WHEN lv <= {n} THEN struct_pack(lv := lv, title := title) END IGNORE NULLS) OVER w AS l{n}" for n in range(1, 7))
_TITLES = ", ".join(f"CASE WHEN l{n}.lv = {n} THEN l{n}.title END" for n in range(2, 7))
SECTIONS = f"""hd AS ({HEADING_SQL}), ty AS (SELECT *, {TYPE_SQL} AS k, {single_line_sql('text')} AS title FROM ({TYPED_SQL})),
    bd AS (SELECT a.*, CASE WHEN a.k = 'heading' AND hd.accepted THEN hd.level END AS lv, a.k = 'heading' AND hd.reason = 'unnumbered_heading' AS loose FROM ty a JOIN hd USING (line_id) WHERE a.k NOT IN ('header', 'footer', 'page_number')),
    rn AS (SELECT *, lv IS NOT NULL AND NOT (loose AND coalesce(lag(loose) OVER w, false)) AS begins FROM bd WINDOW w AS (PARTITION BY page_id ORDER BY line_no, line_id)),
    rr AS (SELECT *, sum(CASE WHEN begins OR lv IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line_no, line_id) AS run FROM rn),
    tt AS (SELECT page_id, run, string_agg(title, ' / ' ORDER BY line_no, line_id) AS joined FROM rr WHERE lv IS NOT NULL GROUP BY ALL),
    jn AS (SELECT rr.* REPLACE (coalesce(tt.joined, rr.title) AS title) FROM rr LEFT JOIN tt ON tt.page_id = rr.page_id AND tt.run = rr.run),
    mk AS (SELECT *, count(CASE WHEN begins THEN 1 END) OVER w AS section_no, {_MARKS} FROM jn WINDOW w AS (PARTITION BY source_id ORDER BY page_id, line_no, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    sections AS (SELECT mk.*, concat_ws(' > ', coalesce(CASE WHEN l1.lv = 1 THEN l1.title END, s.title), {_TITLES}) AS section_path FROM mk LEFT JOIN (SELECT source_id, any_value(title) AS title FROM source_spec GROUP BY source_id) s USING (source_id))"""


@query(f"WITH {SECTIONS} SELECT line_id, section_no, section_path FROM sections")
def section_path(spark: SparkSession, folder: str) -> DataFrame:
    """Section and path of every body line."""
    return layout.section_paths(layout.typed_lines(read_table(spark, folder, "layout_line")), read_table(spark, folder, "source_spec")).select("line_id", "section_no", "section_path")


@query(f"""
    WITH p AS (SELECT page_id, source_id, count(*) AS lines, sum(CASE WHEN source = 'native' THEN length(text) ELSE 0 END) AS native_chars, sum(CASE WHEN source = 'ocr' THEN length(text) ELSE 0 END) AS ocr_chars FROM {LINES} GROUP BY ALL)
    SELECT page_id, source_id, lines, native_chars::BIGINT AS native_chars, ocr_chars::BIGINT AS ocr_chars, CASE WHEN native_chars >= 80 AND ocr_chars > 0 THEN 'mixed' WHEN native_chars >= 80 THEN 'native' WHEN ocr_chars > 0 THEN 'ocr' ELSE 'blank' END AS method FROM p""")
def extraction_path(spark: SparkSession, folder: str) -> DataFrame:
    """How the text of each page is to be had: from its text layer, by reading the scan, or both."""
    pages = layout.page_text(read_table(spark, folder, "layout_line"))
    method = F.when((F.col("native_chars") >= 80) & (F.col("ocr_chars") > 0), "mixed").when(F.col("native_chars") >= 80, "native").when(F.col("ocr_chars") > 0, "ocr").otherwise("blank")
    return pages.select("page_id", "source_id", "lines", "native_chars", "ocr_chars", method.alias("method"))


@query()
def same_row_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned lines that lie in one row, merged by the running mean of their centres."""
    return layout.same_row_merge(read_table(spark, folder, "ocr_line"))


@query("""
    SELECT page_id, line_no, greatest(0, least(1, x0)) AS x0, greatest(0, least(1, y0)) AS y0, greatest(round((y1 - y0) * 1000, 6), 1.0) AS pseudo_font,
        coalesce(CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END, 0) AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, line_no) AS position
    FROM (SELECT DISTINCT * FROM ocr_line) WHERE trim(text, ' ') <> ''""")
def ocr_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of scanned lines within the page, in reading order, with a font size from their height."""
    lines = read_table(spark, folder, "ocr_line").distinct().where(F.trim("text") != "")
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))).alias(c)
    score = F.coalesce(F.when(F.col("confidence") > 1, F.col("confidence") / 100).otherwise(F.col("confidence")), F.lit(0.0))
    order = Window.partitionBy("page_id").orderBy("y0", "x0", "line_no")
    return lines.select("page_id", "line_no", inside("x0"), inside("y0"), F.greatest(F.round((F.col("y1") - F.col("y0")) * 1000, 6), F.lit(1.0)).alias("pseudo_font"), score.alias("confidence"), F.row_number().over(order).alias("position"))


@query(f"SELECT page_id, text, count(*) AS n, min(nth) AS nth FROM (SELECT page_id, {single_line_sql('text')} AS text, row_number() OVER (PARTITION BY page_id, {single_line_sql('text')} ORDER BY line_no, line_id) AS nth FROM {LINES}) GROUP BY ALL HAVING count(*) > 1")
def repeated_on_page(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that occur more than once on their page, by occurrence."""
    lines = read_table(spark, folder, "layout_line").dropDuplicates(["line_id"]).withColumn("text", tx.single_line(F.col("text")))
    lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy("page_id", "text").orderBy("line_no", "line_id")))
    return lines.groupBy("page_id", "text").agg(F.count("*").alias("n"), F.min("nth").alias("nth")).where("n > 1")


@query(f"SELECT page_id, bool_and(line_no = nth) AS contiguous, count(*) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no, line_id) AS nth FROM {LINES}) GROUP BY page_id")
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the line numbers of each page run from 1 without a gap."""
    lines = read_table(spark, folder, "layout_line").dropDuplicates(["line_id"])
    lines = lines.withColumn("nth", F.row_number().over(Window.partitionBy("page_id").orderBy("line_no", "line_id")))
    return lines.groupBy("page_id").agg(F.bool_and(F.col("line_no") == F.col("nth")).alias("contiguous"), F.count("*").alias("lines"))


# Printed page labels, what viewers print beside them, and the label at the start of a footer.
LABEL = r"(\d{1,4}|[ivxlcdmIVXLCDM]{1,8}|[A-Za-z]-?\d{1,4})"
VIEWER = r"(?i)(page\s*\(|\d+\s*/\s*\d+|100%)"


@query(rf"""
    WITH b AS (SELECT *, trim(text, ' ') AS t FROM (SELECT DISTINCT * FROM ocr_line) WHERE (y0 >= 0.84 OR y1 <= 0.12) AND NOT regexp_matches(text, '{VIEWER}')),
    c AS (SELECT *, CASE WHEN regexp_full_match(t, '{LABEL}') THEN t WHEN y0 >= 0.92 AND y1 > 0.08 THEN nullif(regexp_extract(t, '^{LABEL}\s+.+$', 1), '') END AS label FROM b),
    s AS (SELECT *, CASE WHEN regexp_full_match(t, '{LABEL}') AND (y0 >= 0.88 OR y1 <= 0.12) THEN 98 ELSE 90 END + CASE WHEN y0 >= 0.84 THEN 1 ELSE 0 END AS points FROM c WHERE label IS NOT NULL)
    SELECT page_id, label, (points / 100)::DOUBLE AS score, TRY_CAST(label AS INT) AS printed FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY points DESC, line_no, label) AS n FROM s) WHERE n = 1""")
def printed_page(spark: SparkSession, folder: str) -> DataFrame:
    """The printed page label of each scanned page: the best one in its top or bottom band."""
    lines = read_table(spark, folder, "ocr_line").distinct().withColumn("t", F.trim("text"))
    bottom, number = F.col("y0") >= 0.84, F.col("t").rlike(f"^{LABEL}$")
    band = lines.where((bottom | (F.col("y1") <= 0.12)) & ~F.col("text").rlike(VIEWER))
    footer = F.regexp_extract("t", rf"^{LABEL}\s+.+$", 1)
    band = band.withColumn("label", F.when(number, F.col("t")).when((F.col("y0") >= 0.92) & (F.col("y1") > 0.08) & (footer != ""), footer)).where("label IS NOT NULL")
    points = F.when(number & ((F.col("y0") >= 0.88) | (F.col("y1") <= 0.12)), 98).otherwise(90) + F.when(bottom, 1).otherwise(0)
    best = F.min(F.struct((-points).alias("points"), "line_no", "label")).alias("b")
    return band.groupBy("page_id").agg(best).select("page_id", "b.label", (-F.col("b.points") / 100).alias("score"), F.col("b.label").try_cast("int").alias("printed"))


_PIECES = "list_transform(string_split(x, '|'), lambda p: trim(p, ' '))"
_PIECES = f"list_filter({_PIECES}, lambda p: NOT regexp_matches(p, '(?i)^(page\\s*\\(\\s*\\d+\\s*/\\s*\\d+\\s*\\)|-?\\s*100%\\s*\\+?)$'))"
_PIECES = f"list_transform({_PIECES}, lambda p: trim(regexp_replace(p, '(?i)([-+]?\\s*100%\\s*[-+]?|\\+?\\s*page\\s*\\(\\s*\\d+\\s*/\\s*\\d+\\s*\\))', '', 'g'), ' +-|'))"
_CLEAN = f"array_to_string(list_filter({_PIECES}, lambda p: p <> ''), ' | ')"


@query(f"SELECT line_id, {NORMAL.replace('text', 'c')} AS text FROM (SELECT line_id, array_to_string(list_filter(list_transform(string_split({NORMAL}, chr(10)), lambda x: {_CLEAN}), lambda x: x <> ''), chr(10)) AS c FROM {LINES} WHERE contains(text, '|'))")
def overlay_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Layout lines with bars, without what share bars and viewers left in them."""
    lines = read_table(spark, folder, "layout_line").dropDuplicates(["line_id"]).where(F.contains("text", F.lit("|")))
    return lines.select("line_id", tx.without_overlays(F.col("text")).alias("text"))


@query(f"""
    WITH p AS (SELECT page_id, source_id, string_agg(text, chr(10) ORDER BY line_no, line_id) AS text FROM {LINES} GROUP BY ALL),
    s AS (SELECT *, length(text) AS n, list_sum(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN len(regexp_extract_all(x, '\\S*\\d\\S*')) >= 2 THEN len(regexp_extract_all(x, '\\S*\\d\\S*')) ELSE 0 END + CASE WHEN contains(x, chr(9)) OR contains(x, '  ') THEN 2 ELSE 0 END)) AS likeness,
        row_number() OVER (PARTITION BY source_id ORDER BY page_id) AS nth, count(*) OVER (PARTITION BY source_id) AS pages FROM p)
    SELECT source_id, max(pages) AS pages, arg_min(page_id, struct_pack(n := n, p := page_id)) AS shortest, arg_max(page_id, struct_pack(n := n, p := page_id)) AS longest, arg_max(page_id, struct_pack(n := likeness, p := page_id)) AS most_tabular,
        max(CASE WHEN nth = 1 THEN page_id END) AS first, max(CASE WHEN nth = (pages + 1) // 2 THEN page_id END) AS middle, max(CASE WHEN nth = pages THEN page_id END) AS last FROM s GROUP BY source_id""")
def representative_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that stand for a source: its shortest, longest, most table-like, first, middle and last."""
    pages = layout.page_text(read_table(spark, folder, "layout_line")).withColumn("n", F.length("text")).withColumn("likeness", tx.table_likeness(F.col("text")))
    pages = layout.numbered_pages(pages.select("source_id", "page_id", "n", "likeness")).withColumn("nth", F.col("pos") + 1)
    pick = lambda f, *by: f("page_id", F.struct(*by))
    at = lambda place: F.max(F.when(F.col("nth") == place, F.col("page_id")))
    return pages.groupBy("source_id").agg(
        F.max("pages").alias("pages"), pick(F.min_by, "n", "page_id").alias("shortest"), pick(F.max_by, "n", "page_id").alias("longest"), pick(F.max_by, "likeness", "page_id").alias("most_tabular"),
        at(F.lit(1)).alias("first"), at(F.floor((F.col("pages") + 1) / 2)).alias("middle"), at(F.col("pages")).alias("last"),
    )


CHUNKS = """
    WITH RECURSIVE u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, t, len(list_filter(regexp_split_to_array(trim(t, ' '), '\\s+'), lambda w: w <> '')) AS n
        FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t, ' ') <> ''),
    r AS (SELECT doc_id, i, n AS cur, 0 AS c FROM u WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN r.cur + u.n > 200 OR (r.cur >= 75 AND r.cur + u.n > 150) THEN u.n ELSE r.cur + u.n END, CASE WHEN r.cur + u.n > 200 OR (r.cur >= 75 AND r.cur + u.n > 150) THEN r.c + 1 ELSE r.c END
        FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1),
    g AS (SELECT r.doc_id, any_value(u.source) AS source, r.c, min(r.i) AS first, count(*) AS n, sum(u.n) AS tokens, string_agg(u.t, chr(10) || chr(10) ORDER BY u.i) AS text FROM r JOIN u USING (doc_id, i) GROUP BY r.doc_id, r.c),
    m AS (SELECT *, lag(tokens) OVER w AS before, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) AS back FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY c)),
    k AS (SELECT *, CASE WHEN back = 1 AND tokens < 75 AND before + tokens <= 200 THEN c - 1 ELSE c END AS chunk FROM m),
    chunks AS (SELECT doc_id, any_value(source) AS source, chunk AS chunk_no, min(first) - 1 AS first_unit, sum(n)::INT AS n_units, sum(tokens)::INT AS tokens, string_agg(text, chr(10) || chr(10) ORDER BY c) AS text FROM k GROUP BY doc_id, chunk)"""


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.pack_units(chunking.document_units(read_table(spark, folder, "documents")))


@query(CHUNKS + " SELECT doc_id, chunk_no, first_unit, n_units, tokens FROM chunks")
def chunk_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents packed greedily into chunks."""
    return _chunks(spark, folder).select("doc_id", "chunk_no", "first_unit", "n_units", "tokens")


@query(CHUNKS + """, j AS (SELECT *, '{"page_ids":["' || doc_id || '"],"source_id":"' || coalesce(source, 'none') || '","text_hash":"' || sha256(text) || '"}' AS body FROM chunks)
    SELECT doc_id, chunk_no, coalesce(source, 'none') || ':c_' || substr(sha256(body), 1, 24) AS chunk_id FROM j""")
def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Content-addressed ids of chunks."""
    source = F.coalesce("source", F.lit("none"))
    return _chunks(spark, folder).select("doc_id", "chunk_no", tx.chunk_id(source, F.array(F.col("doc_id").cast("string")), F.col("text")).alias("chunk_id"))


@query(CHUNKS + """ SELECT coalesce(source, 'none') AS source, count(*) AS chunks, count(DISTINCT doc_id) AS documents, count_if(tokens < 75) AS small, count_if(tokens BETWEEN 75 AND 150) AS medium, count_if(tokens > 150 AND tokens <= 200) AS large, count_if(tokens > 200) AS over,
    min(tokens) AS least, quantile_disc(tokens, 0.5) AS p50, quantile_disc(tokens, 0.95) AS p95, max(tokens) AS most FROM chunks GROUP BY coalesce(source, 'none')""")
def chunk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of each source by size, with nearest-rank percentiles."""
    chunks = _chunks(spark, folder).select(F.coalesce("source", F.lit("none")).alias("source"), "doc_id", "tokens")
    t = F.col("tokens")
    rank = lambda p: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY tokens) AS int)")
    return chunks.groupBy("source").agg(
        F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"), F.count_if(t < 75).alias("small"), F.count_if(t.between(75, 150)).alias("medium"), F.count_if((t > 150) & (t <= 200)).alias("large"), F.count_if(t > 200).alias("over"),
        F.min(t).alias("least"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max(t).alias("most"),
    )


_TOKEN = r"(?:[㐀-䶿一-鿿]|[^\s\x01-\x03㐀-䶿一-鿿]+)"
SPLIT = rf"""
    WITH RECURSIVE mk AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace({NORMAL}, chr(10) || chr(10), chr(1)), chr(10), chr(2)), '([。！？!?；;])\s*', '\1' || chr(3), 'g'), '\.\s+([A-Z0-9])', '.' || chr(3) || '\1', 'g') AS t FROM documents),
    pc AS (SELECT doc_id, flatten(list_transform(regexp_extract_all(t, '[^\x01-\x03]+[\x01-\x03]*'), lambda p: CASE WHEN len(regexp_extract_all(p, '{_TOKEN}')) > 200 THEN regexp_extract_all(p, '(?:{_TOKEN}[\s\x01-\x03]*){{1,200}}') ELSE [p] END)) AS l FROM mk),
    u AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i, len(regexp_extract_all(unnest(l), '{_TOKEN}')) AS n FROM pc),
    r AS (SELECT doc_id, i, n AS cur, 0 AS c FROM u WHERE i = 1
        UNION ALL SELECT u.doc_id, u.i, CASE WHEN r.cur > 0 AND r.cur + u.n > 200 THEN u.n ELSE r.cur + u.n END, CASE WHEN r.cur > 0 AND r.cur + u.n > 200 THEN r.c + 1 ELSE r.c END FROM r JOIN u ON u.doc_id = r.doc_id AND u.i = r.i + 1),
    g AS (SELECT doc_id, c AS part, sum(n)::INT AS tokens, string_agg(t, '' ORDER BY i) AS t FROM r JOIN u USING (doc_id, i) GROUP BY ALL)
    SELECT doc_id, part, tokens, sha256(regexp_replace(replace(replace(replace(regexp_replace(t, '([。！？；])\x03', '\1', 'g'), chr(3), ' '), chr(2), chr(10)), chr(1), chr(10) || chr(10)), '^\s+|\s+$', '', 'g')) AS text_hash FROM g WHERE tokens > 0"""


@query(SPLIT)
def chunk_split(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in parts of at most 200 tokens, split where they part most naturally."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.posexplode(chunking.split_text(F.col("text"))).alias("part", "p"))
    return docs.select("doc_id", "part", "p.tokens", F.sha2("p.text", 256).alias("text_hash"))


_BLOCKS = f"""bl AS (WITH a AS (SELECT *, {TYPE_SQL} AS k FROM ({TYPED_SQL})),
    b AS (SELECT *, CASE WHEN k = lag(k) OVER w AND k IN ('paragraph', 'table') AND y0 - lag(y1) OVER w <= 0.035 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY page_id ORDER BY line_no, line_id)),
    c AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY line_no, line_id) - 1 AS block_no FROM b)
    SELECT source_id, page_id, block_no::BIGINT AS block_no, min(k) AS block_type, CASE WHEN min(k) = 'paragraph' THEN list_reduce(list(text ORDER BY line_no, line_id), lambda s, x: CASE WHEN s LIKE '%-' AND regexp_matches(x, '^[a-zäöüß]') THEN s[:-2] || x
        WHEN regexp_matches(s, '[，。；：！？、,.!?;:]$') OR regexp_matches(x, '^[)）,.]') THEN s || x ELSE s || ' ' || x END) ELSE string_agg(text, chr(10) ORDER BY line_no, line_id) END AS text, min(line_id) AS line_id FROM c GROUP BY source_id, page_id, block_no)"""
UNITS = f"""{_BLOCKS}, {SECTIONS},
    sb AS (SELECT bl.*, s.section_no, s.section_path, s.run, s.lv, {single_line_sql('bl.text')} AS flat FROM bl JOIN sections s ON s.line_id = bl.line_id),
    k1 AS (SELECT *, CASE WHEN lv IS NOT NULL THEN 'title' WHEN block_type = 'table_caption' THEN 'table_caption' WHEN block_type = 'table' OR contains(flat, '|') THEN 'table' WHEN block_type = 'list_item' OR regexp_matches(flat, '{P["list_sentence"]}') THEN 'list'
        WHEN block_type = 'formula' THEN 'formula' WHEN block_type = 'figure_caption' THEN 'figure' ELSE 'text' END AS k0 FROM sb),
    k2 AS (SELECT *, CASE WHEN block_type = 'paragraph' AND coalesce(last_value(CASE WHEN block_type <> 'paragraph' OR k0 = 'list' THEN k0 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'list' THEN 'listed' ELSE k0 END AS kind FROM k1),
    k3 AS (SELECT *, CASE WHEN kind = 'listed' OR (kind IN ('table', 'formula') AND coalesce(last_value(CASE WHEN kind <> 'formula' THEN kind END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') IN ('table', 'table_caption'))
        OR (lv IS NOT NULL AND lag(lv) OVER w IS NOT NULL AND run = lag(run) OVER w) THEN 0 ELSE 1 END AS new FROM k2 WINDOW w AS (PARTITION BY page_id ORDER BY block_no)),
    k4 AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY block_no) - 1 AS unit_no FROM k3),
    un AS (SELECT source_id, page_id, unit_no::BIGINT AS unit_no, replace(arg_min(kind, block_no), 'table_caption', 'table') AS kind, min(section_no) AS section_no, arg_min(section_path, block_no) AS section_path, count(*)::INT AS blocks, string_agg(text, chr(10) ORDER BY block_no) AS text FROM k4 GROUP BY source_id, page_id, k4.unit_no),
    units AS (SELECT * EXCLUDE (text), {NORMAL} AS text FROM un)"""


@query(f"WITH {UNITS} SELECT source_id, page_id, unit_no, kind, section_no, section_path, blocks, len(regexp_extract_all(text, '{_TOKEN}'))::INT AS tokens, sha256(text) AS text_hash FROM units")
def section_units(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, lists, tables and texts of the pages, each in its section."""
    units = chunking.section_units(read_table(spark, folder, "layout_line"), read_table(spark, folder, "source_spec"))
    return units.select("source_id", "page_id", "unit_no", "kind", "section_no", "section_path", "blocks", "tokens", F.sha2("text", 256).alias("text_hash"))


# The parts of running text beyond 200 tokens, by the same steps as those of documents.
_PARTS = SPLIT.replace("WITH RECURSIVE mk AS", "marked AS").replace("FROM mk)", "FROM marked)").replace("FROM documents", "FROM big").split("    SELECT doc_id, part, tokens, sha256(")[0].rstrip()
_PLAIN = SPLIT.rsplit("sha256(", 1)[1].rsplit(") AS text_hash", 1)[0]
_SECTION_CHUNKS = f"""WITH RECURSIVE {UNITS},
    o AS (SELECT *, len(regexp_extract_all(text, '{_TOKEN}')) AS n, floor(TRY_CAST(regexp_extract(page_id, '(\\d+)$', 1) AS BIGINT) / 1000)::BIGINT AS part, page_id || '#' || unit_no AS doc_id FROM units),
    big AS (SELECT doc_id, text FROM o WHERE kind = 'text' AND n > 200), {_PARTS},
    a1 AS (SELECT source_id, section_no, part, section_path, page_id, unit_no, kind, 0 AS piece, text AS t, n FROM o WHERE NOT (kind = 'text' AND n > 200)
        UNION ALL SELECT o.source_id, o.section_no, o.part, o.section_path, o.page_id, o.unit_no, o.kind, g.part, {_PLAIN.replace("(t,", "(g.t,")}, g.tokens FROM o JOIN g ON g.doc_id = o.doc_id WHERE g.tokens > 0),
    z AS (SELECT *, kind = 'title' AS title, row_number() OVER (PARTITION BY source_id, section_no, part ORDER BY page_id, unit_no, piece) AS i FROM a1),
    q AS (SELECT source_id, section_no, part, i, n AS cur, 0 AS c, title AS titles FROM z WHERE i = 1
        UNION ALL SELECT z.source_id, z.section_no, z.part, z.i, CASE WHEN (q.cur + z.n > 200 AND NOT q.titles) OR (q.cur >= 75 AND q.cur + z.n > 150) THEN z.n ELSE q.cur + z.n END, CASE WHEN (q.cur + z.n > 200 AND NOT q.titles) OR (q.cur >= 75 AND q.cur + z.n > 150) THEN q.c + 1 ELSE q.c END,
            CASE WHEN (q.cur + z.n > 200 AND NOT q.titles) OR (q.cur >= 75 AND q.cur + z.n > 150) THEN z.title ELSE q.titles AND z.title END
        FROM q JOIN z ON z.source_id = q.source_id AND z.section_no = q.section_no AND z.part = q.part AND z.i = q.i + 1),
    y AS (SELECT z.*, q.c FROM z JOIN q USING (source_id, section_no, part, i)),
    h AS (SELECT source_id, section_no, part, c, sum(n) AS tokens FROM y GROUP BY ALL),
    m AS (SELECT *, lag(tokens) OVER v AS before, row_number() OVER (PARTITION BY source_id, section_no, part ORDER BY c DESC) AS back FROM h WINDOW v AS (PARTITION BY source_id, section_no, part ORDER BY c)),
    f AS (SELECT y.*, CASE WHEN back = 1 AND tokens < 75 AND before + tokens <= 200 THEN y.c - 1 ELSE y.c END AS chunk FROM y JOIN m USING (source_id, section_no, part, c))
    SELECT source_id, section_no, part, chunk AS chunk_no, any_value(section_path) AS section_path, min(page_id) AS first_page, max(page_id) AS last_page, count(*)::INT AS units, sum(n)::INT AS tokens, max(n) > 200 AS oversized, sha256(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS text_hash FROM f GROUP BY source_id, section_no, part, chunk"""


@query(_SECTION_CHUNKS)
def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of sources packed into chunks, from layout lines on."""
    chunks = chunking.section_chunks(chunking.section_units(read_table(spark, folder, "layout_line"), read_table(spark, folder, "source_spec")))
    return chunks.withColumn("text_hash", F.sha2("text", 256)).drop("text")


UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id))"


@query(f"""SELECT DISTINCT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
    FROM (SELECT chunk_id, {UUID} AS h FROM qdrant_input)""")
def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    """UUIDs (version 5) of chunks."""
    return read_table(spark, folder, "qdrant_input").select("chunk_id", tx.uuid5(F.col("chunk_id"), "6ba7b8119dad11d180b400c04fd430c8").alias("point_id")).distinct()


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "title", "text")
    return tagging.matches(docs)


def _term(c: str, term: str) -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')" if any(x in "abcdefghijklmnopqrstuvwxyz0123456789" for x in term) else f"contains({c}, '{term}')"


_RULES = [(kind, tag, term) for kind, tag, terms in tagging.RULES for term in terms]
MATCHES = "WITH low AS (SELECT doc_id AS key, lower(coalesce(title, '')) AS title, lower(coalesce(text, '')) AS text FROM documents WHERE trim(lower(coalesce(title, '')), ' ') NOT IN ({})), m AS ({})".format(
    ", ".join(f"'{t}'" for t in tagging.EXCLUDED),
    " UNION ALL ".join(f"SELECT key, '{kind}' AS kind, '{tag}' AS tag, '{term}' AS term, CASE WHEN {_term('title', term)} THEN 'title' ELSE 'text' END AS matched_in FROM low WHERE {_term('title', term)} OR {_term('text', term)}" for kind, tag, term in _RULES),
)


@query(MATCHES + " SELECT key AS doc_id, kind, tag, term, matched_in FROM m")
def term_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every match of a tagging rule: in the title, else in the text."""
    return _tagged(spark, folder).withColumnRenamed("key", "doc_id")


@query(MATCHES + """ SELECT key AS doc_id, array_to_string(list_filter([{}], lambda t: list_contains(have, t)), ',') AS tags, n_matches, CASE WHEN t AND b THEN 'mixed' WHEN t THEN 'title' ELSE 'text' END AS origin
    FROM (SELECT key, list(DISTINCT tag) AS have, count(*) AS n_matches, bool_or(matched_in = 'title') AS t, bool_or(matched_in = 'text') AS b FROM m GROUP BY key)""".format(", ".join(f"'{t}'" for t in tagging.ORDER)))
def term_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of each document in canonical order, and where they come from."""
    return tagging.tags(_tagged(spark, folder)).withColumnRenamed("key", "doc_id")


@query(MATCHES + " SELECT r.kind, r.tag, count(DISTINCT m.key) AS texts FROM (VALUES {}) r(kind, tag) LEFT JOIN m ON m.tag = r.tag GROUP BY ALL".format(", ".join(f"('{k}', '{t}')" for k, t, _ in tagging.RULES)))
def tag_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by tag, also of tags that none has."""
    return tagging.tag_counts(_tagged(spark, folder))


@query(MATCHES + " SELECT term, count(DISTINCT key) AS texts FROM m WHERE key IN (SELECT key FROM m GROUP BY key HAVING count(DISTINCT tag) > 1) GROUP BY term")
def ambiguous_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms by the number of documents that carry them together with those of another tag."""
    found = _tagged(spark, folder)
    several = found.groupBy("key").agg(F.countDistinct("tag").alias("n")).where("n > 1").select("key")
    return found.join(several, "key", "left_semi").groupBy("term").agg(F.countDistinct("key").alias("texts"))


@query("""SELECT coalesce(source, 'none') AS source, count(*) AS documents, count_if(lang IS NULL) AS no_language, count_if(trim(coalesce(text, ''), ' ') = '') AS blank, count(DISTINCT document_type) AS types, min(published_at) AS first, max(published_at) AS last,
    quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95 FROM documents GROUP BY coalesce(source, 'none')""")
def source_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of each source: counts by state and nearest-rank percentiles of their length."""
    docs = read_table(spark, folder, "documents").withColumn("source", F.coalesce("source", F.lit("none")))
    rank = lambda p: F.expr(f"cast(percentile_disc({p}) WITHIN GROUP (ORDER BY n_chars) AS bigint)")
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if(F.col("lang").isNull()).alias("no_language"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"), F.countDistinct("document_type").alias("types"),
        F.min("published_at").alias("first"), F.max("published_at").alias("last"), rank(0.5).alias("p50"), rank(0.95).alias("p95"),
    )


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS kept, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_kept FROM documents")
def dedupe_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    """The document that stands for each exact copy: the one with the smallest id."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("\x00")), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("kept"))
    return docs.join(first, "h").select("doc_id", "kept", (F.col("doc_id") == F.col("kept")).alias("is_kept"))
