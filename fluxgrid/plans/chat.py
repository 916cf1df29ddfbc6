"""Queries over the chat store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.operators import chat
from fluxgrid.plans.registry import query
from fluxgrid.sources.tables import read_table

ROWS = "(SELECT *, lower(trim(conversation_id, ' ')) AS conversation FROM (SELECT DISTINCT * FROM messages) WHERE conversation_id IS NOT NULL)"


@query(f"""SELECT row_id, conversation, count(*) OVER w AS before, sha256(coalesce(array_to_string(list(coalesce(content, '')) OVER w, chr(10)), '')) AS context_hash FROM {ROWS}
    WINDOW w AS (PARTITION BY conversation ORDER BY row_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def conversation_context(spark: SparkSession, folder: str) -> DataFrame:
    """What a turn was answered from: the six messages stored before it."""
    return chat.context(read_table(spark, folder, "messages"))


_CASES = " ".join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{name}'" for name, words in chat.INTENTS.items())


@query(f"SELECT row_id, conversation, CASE {_CASES} ELSE 'follow_up' END AS intent FROM (SELECT *, lower(coalesce(content, '')) AS t FROM {ROWS} WHERE lower(trim(role, ' ')) IN ('user', 'human'))")
def conversation_intents(spark: SparkSession, folder: str) -> DataFrame:
    """What each user turn wants."""
    return chat.intents(read_table(spark, folder, "messages"))


@query("""SELECT lower(trim(conversation_id, ' ')) AS conversation, count(DISTINCT updated_at) AS updates, (arg_max(state_json, struct_pack(u := updated_at, s := state_json))::JSON ->> '$.case_version')::INT AS version, arg_max(state_json, struct_pack(u := updated_at, s := state_json))::JSON ->> '$.status' AS status
    FROM conversations WHERE conversation_id IS NOT NULL GROUP BY lower(trim(conversation_id, ' '))""")
def conversation_state(spark: SparkSession, folder: str) -> DataFrame:
    """The latest snapshot of each conversation's state."""
    return chat.latest(read_table(spark, folder, "conversations"))


@query(f"""SELECT conversation, sum(n)::BIGINT AS actual, sum(least(n, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 2 WHEN 'system' THEN 1 ELSE 0 END))::BIGINT AS matched, round(sum(least(n, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 2 WHEN 'system' THEN 1 ELSE 0 END)) / sum(n), 6) AS precision, round(sum(least(n, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 2 WHEN 'system' THEN 1 ELSE 0 END)) / 5, 6) AS recall
    FROM (SELECT conversation, lower(trim(role, ' ')) AS role, count(*) AS n FROM {ROWS} GROUP BY ALL) GROUP BY conversation""")
def sequence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Roles of each conversation against an expected sequence, as multisets: matches, precision, recall."""
    expected = ["system", "user", "assistant", "user", "assistant"]
    rows = chat.sequence_match(read_table(spark, folder, "messages"), expected)
    return rows.select("conversation", "actual", "matched", F.round(F.col("matched") / F.col("actual"), 6).alias("precision"), F.round(F.col("matched") / len(expected), 6).alias("recall"))


@query("""SELECT event_id, json_merge_patch('{"k": 0, "source": "default", "nested": {"a": 1}}', props)::JSON ->> '$.k' AS k, json_merge_patch('{"k": 0, "source": "default"}', props)::JSON ->> '$.source' AS source FROM events""")
def merged_json(spark: SparkSession, folder: str) -> DataFrame:
    """Properties over defaults, the given ones win."""
    rows = read_table(spark, folder, "events")
    return rows.select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("0")).alias("k"), F.coalesce(F.get_json_object("props", "$.source"), F.lit("default")).alias("source"))


@query(f"SELECT coalesce(m.metadata_json::JSON ->> '$.intent', 'none') AS intent, count(*) AS rows_seen, count(DISTINCT conversation) AS conversations FROM {ROWS} m GROUP BY ALL")
def metadata_intents(spark: SparkSession, folder: str) -> DataFrame:
    """Message rows by the intent in their metadata, read by its path."""
    rows = chat.deliveries(read_table(spark, folder, "messages"))
    intent = F.coalesce(F.get_json_object("metadata_json", "$.intent"), F.lit("none"))
    return rows.groupBy(intent.alias("intent")).agg(F.count("*").alias("rows_seen"), F.countDistinct("conversation").alias("conversations"))
