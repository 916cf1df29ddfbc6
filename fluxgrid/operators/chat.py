"""Windows over the messages of a chat store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words by which a turn's intent is told, in order of precedence.
INTENTS = {
    "identify": ["image attached", "which defect", "bild anbei", "附图"],
    "optimize": ["optimi", "improve", "how far can", "verbesser", "优化"],
    "evidence": ["evidence", "source", "according to", "beleg", "证据", "根据记录"],
    "cause": ["why", "cause", "warum", "ursache", "为什么", "原因"],
    "parameter": ["what value", "target", "limit", "wie hoch", "设为", "可以吗"],
}


#: Row ids of a conversation that one task orders.
SPAN = 100_000


def deliveries(messages: DataFrame) -> DataFrame:
    """Message rows once per delivery row, with the conversation's id trimmed and in lower case; null ids belong nowhere."""
    return messages.dropDuplicates(["row_id"]).where("conversation_id IS NOT NULL").withColumn("conversation", F.lower(F.trim("conversation_id")))


def context(messages: DataFrame, last: int = 6) -> DataFrame:
    """row_id, conversation, before: how many of the ``last`` messages stored before this one there are, and their hash.

    A long conversation is cut into spans of ``SPAN`` row ids; what a span needs of those before it are the
    ends of the ``last`` ones that have messages.
    """
    rows = deliveries(messages).select("row_id", "conversation", F.coalesce("content", F.lit("")).alias("content"), F.floor(F.col("row_id") / SPAN).alias("span"))
    span = Window.partitionBy("conversation", "span")
    own = F.collect_list("content").over(span.orderBy("row_id").rowsBetween(-last, -1))
    ends = rows.withColumn("back", F.row_number().over(span.orderBy(F.desc("row_id")))).where(F.col("back") <= last)
    ends = ends.groupBy("conversation", "span").agg(F.sort_array(F.collect_list(F.struct("row_id", "content"))).alias("end"))
    far = F.flatten(F.collect_list("end.content").over(Window.partitionBy("conversation").orderBy("span").rowsBetween(-last, -1)))
    seen = F.concat("far", "own")
    rows = rows.withColumn("own", own).join(ends.select("conversation", "span", far.alias("far")), ["conversation", "span"]).withColumn("seen", seen)
    rows = rows.withColumn("seen", F.slice("seen", F.greatest(F.size("seen") - last, F.lit(0)) + 1, F.lit(last)))
    return rows.select("row_id", "conversation", F.size("seen").cast("long").alias("before"), F.sha2(F.array_join("seen", "\n"), 256).alias("context_hash"))


def intents(messages: DataFrame) -> DataFrame:
    """row_id, intent of each user turn: the first intent of which a word occurs, else follow_up."""
    text, out = F.lower(F.coalesce("content", F.lit(""))), None
    for name, words in INTENTS.items():
        hit = text.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    rows = deliveries(messages).where(F.lower(F.trim("role")).isin("user", "human"))
    return rows.select("row_id", "conversation", out.otherwise("follow_up").alias("intent"))


def latest(conversations: DataFrame) -> DataFrame:
    """conversation, updates, version, status: the snapshot of the latest update; ties go to the larger state."""
    rows = conversations.where("conversation_id IS NOT NULL").withColumn("conversation", F.lower(F.trim("conversation_id")))
    last = F.max_by("state_json", F.struct("updated_at", "state_json"))
    out = rows.groupBy("conversation").agg(F.countDistinct("updated_at").alias("updates"), last.alias("state"))
    return out.select("conversation", "updates", F.get_json_object("state", "$.case_version").cast("int").alias("version"), F.get_json_object("state", "$.status").alias("status"))


def sequence_match(messages: DataFrame, expected: list[str]) -> DataFrame:
    """conversation, actual, matched: size of the multiset intersection of its roles with an expected sequence."""
    rows = deliveries(messages).groupBy("conversation", F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"))
    want = F.lit(0)
    for name in sorted(set(expected)):
        want = F.when(F.col("role") == name, expected.count(name)).otherwise(want)
    return rows.groupBy("conversation").agg(F.sum("n").alias("actual"), F.sum(F.least("n", want)).alias("matched"))


def sequence_summary(messages: DataFrame, expected: list[str]) -> DataFrame:
    """conversations, f1 (mean over them), exact: the share whose roles are ``expected`` in just that order.

    Only a conversation's first roles, one more than are expected, are compared in order, so none is gathered whole.
    """
    scores = sequence_match(messages, expected)
    role = F.lower(F.trim("role"))
    first = deliveries(messages).select("conversation", "row_id", role.alias("role"), F.row_number().over(Window.partitionBy("conversation").orderBy("row_id")).alias("nth")).where(F.col("nth") <= len(expected) + 1)
    roles = F.sort_array(F.collect_list(F.struct("nth", "role")))["role"]
    same = first.groupBy("conversation").agg((roles == F.array(*(F.lit(x) for x in expected))).alias("same"))
    f1 = 2.0 * F.col("matched") / (F.col("actual") + len(expected))
    return scores.join(same, "conversation").agg(F.count("*").alias("conversations"), F.round(F.avg(f1), 6).alias("f1"), F.round(F.count_if("same") / F.count("*"), 6).alias("exact"))
