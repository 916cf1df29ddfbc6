"""DuckDB SQL of those queries that plain SQL can express."""

from fluxgrid.llm.conversations import ROLE_WORDS
from fluxgrid.llm.visual_form import form_sql

_FORMS = " UNION ALL ".join(
    f"SELECT DISTINCT '{table}' AS table_name, {key} AS key, {text} AS text, {form_sql(text)} AS form FROM {table}"
    for table, key, text in (("ocr_result", "page_id", "text"), ("retriever_main", "query_id", "query"))
)
_ROLE = "CASE " + " ".join(f"WHEN lower(trim(role, ' ')) IN ({', '.join(repr(w) for w in words)}) THEN '{kept}'" for kept, words in ROLE_WORDS.items()) + " END"
_SHOWN = "regexp_replace(coalesce(content, ''), '[\\s\\x{A0}\\x{AD}\\x{200B}-\\x{200F}\\x{2060}-\\x{206F}\\x{3000}\\x{FEFF}]+', '', 'g') <> ''"
_USABLE = "{v} IS NOT NULL AND len({v}) = 64 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"

_REPEATED = f"""WITH l AS (SELECT line_id, page_id, source_id, line_no, nullif(trim(regexp_replace(regexp_replace(replace(lower(form), 'ß', 'ss'), '\\s+', ' ', 'g'), '\\p{{Nd}}+', '0', 'g'), ' '), '') AS f
            FROM (SELECT DISTINCT line_id, page_id, source_id, line_no, {form_sql('text')} AS form FROM layout_line)),
        s AS (SELECT source_id, f, count(DISTINCT page_id) AS pages FROM l WHERE f IS NOT NULL GROUP BY ALL),
        p AS (SELECT source_id, count(DISTINCT page_id) AS total FROM l GROUP BY source_id),
        n AS (SELECT l.* FROM l JOIN s USING (source_id, f) JOIN p USING (source_id) WHERE pages >= 4 AND pages >= 0.08 * total)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
        WITH f AS ({_FORMS})
        SELECT DISTINCT a.table_name, a.key AS key_a, b.key AS key_b
        FROM f a JOIN f b ON a.table_name = b.table_name AND a.form = b.form AND a.key < b.key AND a.text <> b.text
    """,
    "p1_classes": f"""
        WITH f AS ({_FORMS}), c AS (SELECT table_name, form, text, count(*) AS copies FROM f GROUP BY ALL), s AS (SELECT table_name, form, count(*) AS texts FROM c GROUP BY ALL)
        SELECT f.table_name, f.key, max(copies) AS copies, max(texts) AS texts FROM f JOIN c ON c.table_name = f.table_name AND c.form = f.form AND c.text = f.text JOIN s ON s.table_name = f.table_name AND s.form = f.form GROUP BY f.table_name, f.key
    """,
    "p1_forms": f"SELECT DISTINCT table_name, key, form FROM ({_FORMS})",
    "p2_found": f"""
        WITH m AS (SELECT *, lower(trim(conversation_id, ' ')) AS c, row_number() OVER (PARTITION BY lower(trim(conversation_id, ' ')), coalesce(lower(trim(message_id, ' ')), row_id::VARCHAR) ORDER BY row_id) AS copy
            FROM (SELECT DISTINCT row_id, message_id, conversation_id, role, content, created_at FROM messages) WHERE conversation_id IS NOT NULL),
        r AS (SELECT c, row_id, message_id, {_ROLE} AS role, {_SHOWN} AS shown, CASE WHEN regexp_full_match(trim(created_at, ' '), '\\d{{12,13}}') THEN created_at::BIGINT * 1000
            WHEN regexp_matches(created_at, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d') THEN epoch_us(TRY_CAST(CASE WHEN regexp_matches(trim(created_at, ' '), '(Z|[+-]\\d\\d:?\\d\\d)$') THEN trim(created_at, ' ') ELSE trim(created_at, ' ') || 'Z' END AS TIMESTAMPTZ)) END AS instant FROM m WHERE copy = 1),
        n AS (SELECT *, row_number() OVER w AS turn, first_value(role) OVER w AS opening, count(*) OVER (PARTITION BY c) AS n FROM r WINDOW w AS (PARTITION BY c ORDER BY instant, row_id)),
        k AS (SELECT c FROM n GROUP BY c HAVING bool_and(coalesce(instant IS NOT NULL AND role IS NOT NULL AND shown AND CASE WHEN opening = 'system' AND turn = 1 THEN true
            WHEN (turn - CASE WHEN opening = 'system' THEN 1 ELSE 0 END) % 2 = 1 THEN role = 'user' ELSE role = 'assistant' END, false))
            AND (any_value(n) - max(CASE WHEN opening = 'system' THEN 1 ELSE 0 END)) % 2 = 0 AND any_value(n) - max(CASE WHEN opening = 'system' THEN 1 ELSE 0 END) >= 2)
        SELECT v.conversation_id, n.turn::INT AS turn, n.message_id FROM n JOIN k USING (c) JOIN (SELECT lower(trim(conversation_id, ' ')) AS c, min(conversation_id) AS conversation_id FROM conversations GROUP BY 1) v USING (c)
    """,
    "p3_found": f"{_REPEATED} SELECT DISTINCT line_id FROM n",
    "p3_clean_pages": f"""{_REPEATED}, d AS (SELECT DISTINCT page_id, source_id, line_no, line_id, text FROM layout_line WHERE source_id IS NOT NULL AND page_id IS NOT NULL),
        k AS (SELECT *, line_id IN (SELECT line_id FROM n) AS gone FROM d)
        SELECT page_id, source_id, count(CASE WHEN NOT gone THEN text END)::INT AS lines, count_if(gone) AS removed, coalesce(string_agg(CASE WHEN NOT gone THEN text END, chr(10) ORDER BY line_no, line_id), '') AS text FROM k GROUP BY ALL
    """,
    "p3_blocks": f"""{_REPEATED.replace("WITH", "WITH RECURSIVE", 1)},
        e AS (SELECT a.source_id, a.f AS x, b.f AS y, count(DISTINCT a.page_id) AS pages FROM n a JOIN n b ON a.source_id = b.source_id AND a.page_id = b.page_id AND b.line_no = a.line_no + 1 JOIN p ON p.source_id = a.source_id
            GROUP BY a.source_id, a.f, b.f, p.total HAVING count(DISTINCT a.page_id) >= 4 AND count(DISTINCT a.page_id) >= 0.08 * p.total),
        w AS (SELECT source_id, x, y FROM e UNION SELECT source_id, y, x FROM e),
        r AS (SELECT DISTINCT source_id, f AS x, f AS y FROM n UNION SELECT r.source_id, r.x, w.y FROM r JOIN w ON w.source_id = r.source_id AND w.x = r.y),
        c AS (SELECT source_id, x AS f, min(y) AS block FROM r GROUP BY ALL),
        o AS (SELECT source_id, f, count(DISTINCT page_id) AS pages, count(DISTINCT line_id) AS lines FROM n GROUP BY ALL),
        t AS (SELECT e.source_id, block, count(*) AS edges, sum(e.pages) AS weight FROM e JOIN c ON c.source_id = e.source_id AND c.f = e.x GROUP BY ALL)
        SELECT c.source_id, c.block, count(*) AS forms, coalesce(any_value(t.edges), 0) AS edges, max(o.pages) AS pages, coalesce(any_value(t.weight), 0)::BIGINT AS weight, sum(o.lines)::BIGINT AS lines
        FROM c JOIN o USING (source_id, f) LEFT JOIN t ON t.source_id = c.source_id AND t.block = c.block GROUP BY c.source_id, c.block
    """,
    "p4_found": f"""
        WITH q AS (SELECT DISTINCT query_id, dense::DOUBLE[] AS v FROM query_vectors WHERE {_USABLE.format(v="dense")}),
        c AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM qdrant_input WHERE {_USABLE.format(v="embedding")}),
        s AS (SELECT query_id, chunk_id, max(list_cosine_similarity(q.v, c.v)) AS score FROM q, c GROUP BY ALL)
        SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM s) WHERE n <= 10
    """,
    "p4_chunk_neighbors": f"""
        WITH c AS (SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM qdrant_input WHERE {_USABLE.format(v="embedding")}),
        q AS (SELECT * FROM c WHERE ('0x' || right(chunk_id, 8))::BIGINT % 20 = 0),
        s AS (SELECT q.chunk_id, c.chunk_id AS neighbor_id, max(list_cosine_similarity(q.v, c.v)) AS score FROM q, c WHERE q.chunk_id <> c.chunk_id GROUP BY ALL)
        SELECT chunk_id, neighbor_id, rank::INT AS rank, round(score, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, neighbor_id) AS rank FROM s) WHERE rank <= 10
    """,
}
