"""Conversations rebuilt from message rows (problem 2).

``export_fragments`` writes the rows as what a paged chat export looks like: fragments of a few messages of
one conversation, each beginning with the last messages of the one before. ``assemble_fragments`` takes any
overlapping fragments: it joins suffixes with prefixes of equal message hashes, keeps the edges of the overlap
graph that are the one longest way out of one fragment and the one longest way into the next, merges the paths by pointer
doubling and drops conversations with a gap, that is with anything but one path through all their fragments,
or with fewer messages on the path than there are. A conversation of any length is spread over its fragments
and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.sources.scratch import cut

# Words for the three speaker roles.
ROLE_WORDS = {
    "user": ["user", "human", "customer", "prompter"],
    "assistant": ["assistant", "bot", "ai", "gpt", "model", "agent"],
    "system": ["system"],
}

# Characters that show nothing, for regular expressions of the JVM.
BLANK = r"\s\u00A0\u00AD\u034F\u061C\u1680\u180E\u2000-\u200F\u2028-\u202F\u205F-\u206F\u2800\u3000\u3164\uFE00-\uFE0F\uFEFF"

#: Messages of a fragment, and those of them that the next fragment has, too.
FRAGMENT, OVERLAP = 4, 2


def clean_id(name: str) -> Column:
    """An id without outer spaces and letter case."""
    return F.lower(F.regexp_replace(F.col(name), f"^[{BLANK}]+|[{BLANK}]+$", ""))


def instant(name: str) -> Column:
    """Microseconds since 1970 (UTC) of a time written as ISO 8601 or as epoch seconds or milliseconds, else null."""
    text = F.trim(F.col(name))
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), F.unix_micros(zoned.try_cast("timestamp")))
    digits = F.when(text.rlike(r"^\d{9,10}$"), text.try_cast("long") * 1_000_000).when(text.rlike(r"^\d{12,13}$"), text.try_cast("long") * 1000)
    return F.coalesce(iso, digits)


def role(name: str) -> Column:
    """user, assistant or system; null for anything else."""
    word, out = F.lower(F.regexp_replace(F.col(name), f"[{BLANK}]+", "")), F.lit(None).cast("string")
    for kept, words in ROLE_WORDS.items():
        out = F.when(word.isin(words), F.lit(kept)).otherwise(out)
    return out


def message_rows(messages: DataFrame) -> DataFrame:
    """One row per message: conversation, message_id, row_id, at, role, shown.

    Rows of a null conversation belong nowhere. Of rows with one message_id in a conversation the smallest
    row_id counts; rows without message_id are messages of their own, rows repeated whole are one.
    """
    rows = messages.where(F.col("conversation_id").isNotNull()).select(
        clean_id("conversation_id").alias("conversation"),
        F.coalesce(clean_id("message_id"), F.concat(F.lit("\x00"), F.col("row_id").cast("string"))).alias("m"),
        F.col("row_id").cast("long").alias("row_id"),
        F.col("message_id").cast("string").alias("message_id"),
        instant("created_at").alias("at"),
        role("role").alias("role"),
        F.coalesce(F.length(F.regexp_replace("content", f"[{BLANK}]+", "")) > 0, F.lit(False)).alias("shown"),
    )
    first = rows.groupBy("conversation", "m").agg(F.min(F.struct("row_id", "message_id", "at", "role", "shown")).alias("r"))
    return first.select("conversation", "r.*")


def message_hash() -> Column:
    """What two copies of one message share."""
    return F.xxhash64("conversation", "row_id", "message_id", "at", "role")


def export_fragments(rows: DataFrame, size: int = FRAGMENT, overlap: int = OVERLAP) -> DataFrame:
    """Conversations as overlapping fragments (conversation, fragment, messages, items); ``messages`` is the whole number.

    Order: at (null first), then row_id. Rows are numbered in one order of all conversations by range
    partitioning, so that a long conversation is sorted by many tasks. A fragment begins every ``size`` less
    ``overlap`` messages, as long as the one before doesn't reach the end.
    """
    order = ["conversation", "at", "row_id"]
    kind = F.when(F.col("at").isNotNull() & F.col("shown"), F.substring("role", 1, 1))
    rows = rows.select(*order, "message_id", F.coalesce(kind, F.lit("")).alias("kind"), message_hash().alias("h"))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("place", F.monotonically_increasing_id()), "messages")
    # An id is the partition in the upper bits and the row in the lower 33; one row per partition is numbered on.
    part = F.shiftright("place", 33)
    parts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    placed = placed.withColumn("part", part).join(F.broadcast(bases), "part")
    placed = placed.withColumn("place", F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("part", "base")
    wholes = placed.groupBy("conversation").agg(F.min("place").alias("first"), F.count("*").alias("messages"))
    step = size - overlap
    placed = placed.join(wholes, "conversation").withColumn("nth", F.col("place") - F.col("first"))
    # Fragment f holds the messages from f * step to f * step + size - 1.
    last = F.floor(F.col("nth") / step)
    placed = placed.withColumn("fragment", F.explode(F.sequence(F.greatest(last - (-(-size // step) - 1), F.lit(0)), last)))
    begins = F.col("fragment") * step
    placed = placed.where((F.col("nth") < begins + size) & ((F.col("fragment") == 0) | (F.col("messages") > begins + overlap)))
    item = F.struct("at", "row_id", "message_id", "kind", "h")
    return placed.groupBy("conversation", "fragment", "messages").agg(F.sort_array(F.collect_list(item)).alias("items"))


def assemble_fragments(fragments: DataFrame, overlap: int = OVERLAP) -> DataFrame:
    """Where each fragment stands in its conversation: conversation, fragment, start, skip.

    ``fragments`` has conversation, fragment and items, an array of structs with the message hash ``h``.
    Two fragments of a conversation overlap if the last 1 to ``overlap`` hashes of one are the first of the
    other; the longest match counts, also among several neighbours. ``start`` is the number of messages before the fragment, ``skip`` the
    number of its items that the fragment before it already has. Conversations with a gap or with an
    ambiguous path are left out.
    """
    ends = fragments.select("conversation", "fragment", F.size("items").alias("n"), F.col("items.h").alias("h"))
    whole = ends.groupBy("conversation").agg(F.count("*").alias("fragments"))
    ends = cut(ends.join(whole, "conversation"), "fragments")
    several = ends.where("fragments > 1")
    length = F.explode(F.sequence(F.lit(1), F.least(F.lit(overlap), F.col("n")))).alias("k")
    tails = several.select("conversation", F.col("fragment").alias("a"), "n", "h", length).select("conversation", "a", "k", F.expr("xxhash64(slice(h, n - k + 1, k))").alias("run"), F.col("n").alias("m"))
    heads = several.select("conversation", F.col("fragment").alias("b"), "h", "n", length).select("conversation", "b", "k", F.expr("xxhash64(slice(h, 1, k))").alias("run"))
    edges = tails.join(heads, ["conversation", "k", "run"]).where("a <> b")
    edges = edges.groupBy("conversation", "a", "b").agg(F.max("k").alias("skip"), F.max("m").alias("m"))
    # The longest overlap of either end counts; where two are as long as each other, the way is ambiguous.
    top, low = F.max(F.struct("skip", "b", "m")), F.min(F.struct((-F.col("skip")).alias("s"), "b"))
    ahead = edges.groupBy("conversation", "a").agg(top.alias("top"), low.alias("low")).where("top.b = low.b").select("conversation", "a", "top.b", "top.skip", "top.m")
    top, low = F.max(F.struct("skip", "a")), F.min(F.struct((-F.col("skip")).alias("s"), "a"))
    behind = edges.groupBy("conversation", "b").agg(top.alias("top"), low.alias("low")).where("top.a = low.a").select("conversation", "b", "top.a")
    edges = ahead.join(behind, ["conversation", "a", "b"])
    back = edges.select("conversation", F.col("b").alias("fragment"), F.col("a").alias("to"), "skip", "m")
    # Each fragment points to the one before it, with the number of messages it gains by that.
    linked = ends.join(back, ["conversation", "fragment"], "left").select(
        "conversation", "fragment", "fragments", F.coalesce("skip", F.lit(0)).alias("skip"), "to", F.coalesce(F.expr("m - skip"), F.lit(0)).cast("long").alias("start"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("steps")
    )
    linked, span, done = cut(linked, "links"), 1, []
    longest = linked.agg(F.max("fragments")).collect()[0][0] or 0
    while True:
        # Pointers span up to ``span`` fragments by now: shorter conversations are finished.
        done.append(linked.where(F.col("fragments") <= span + 1))
        if longest <= span + 1:
            break
        linked = linked.where(F.col("fragments") > span + 1)
        ahead = linked.select("conversation", F.col("fragment").alias("to"), F.col("to").alias("next"), F.col("start").alias("more"), F.col("steps").alias("further"))
        linked = linked.join(ahead, ["conversation", "to"], "left").select(
            "conversation", "fragment", "fragments", "skip", F.col("next").alias("to"), (F.col("start") + F.coalesce("more", F.lit(0))).alias("start"), (F.col("steps") + F.coalesce("further", F.lit(0))).alias("steps")
        )
        linked, span = cut(linked, "links"), span * 2
    linked = reduce(DataFrame.unionByName, done)
    # One path through all fragments: their steps are 0 to n - 1, once each. Those of a circle outgrow n.
    sound = linked.groupBy("conversation").agg(F.max("fragments").alias("n"), F.max("steps").alias("far"), F.sum("steps").alias("all"), F.sum(F.col("steps") * F.col("steps")).alias("squares"))
    sound = sound.where("far = n - 1 AND all = n * (n - 1) / 2 AND squares = n * (n - 1) * (2 * n - 1) / 6").select("conversation")
    return linked.join(sound, "conversation", "left_semi").select("conversation", "fragment", "start", "skip")


def rebuild_conversations(messages: DataFrame, conversations: DataFrame, export: Callable[[DataFrame], DataFrame] = export_fragments, overlap: int = OVERLAP) -> DataFrame:
    """conversation_id, turn, message_id, role of every message of every sound conversation.

    A conversation is kept if it is in ``conversations``, its fragments make one path with all its messages,
    all its messages have a readable time, a known role and content that shows something, and they are at
    most one system message, which comes first, then pairs of user and assistant. Null ids, times, roles and
    contents break a conversation, they are no error; empty tables give no rows; repeated rows of either
    table count once. ``export`` makes fragments of message rows that overlap by at most ``overlap``.
    """
    fragments = cut(export(message_rows(messages)), "fragments")
    placed = fragments.join(assemble_fragments(fragments, overlap), ["conversation", "fragment"])
    items = F.expr("transform(slice(items, skip + 1, size(items)), (x, i) -> struct(start + skip + i AS g, x.message_id AS message_id, x.kind AS kind))")
    placed = placed.select("conversation", "messages", items.alias("items"))
    of = lambda who, odd: F.expr(f"size(filter(items, x -> x.kind = '{who}' AND x.g % 2 = {odd}))")
    counts = placed.select(
        "conversation",
        "messages",
        F.size("items").alias("n"),
        F.expr("size(filter(items, x -> x.kind = 's'))").alias("system"),
        F.expr("size(filter(items, x -> x.kind = 's' AND x.g = 0))").alias("opening"),
        (of("u", 0) + of("a", 1)).alias("plain"),
        (of("u", 1) + of("a", 0)).alias("shifted"),
    )
    counts = counts.groupBy("conversation").agg(F.max("messages").alias("messages"), *(F.sum(c).alias(c) for c in ("n", "system", "opening", "plain", "shifted")))
    good = counts.where("n = messages AND ((system = 0 AND plain = n AND n % 2 = 0 AND n >= 2) OR (system = 1 AND opening = 1 AND shifted = n - 1 AND n % 2 = 1 AND n >= 3))")
    known = conversations.where(F.col("conversation_id").isNotNull()).select(clean_id("conversation_id").alias("conversation"), F.col("conversation_id").cast("string").alias("conversation_id"))
    known = known.groupBy("conversation").agg(F.min("conversation_id").alias("conversation_id"))
    kept = placed.join(good.select("conversation").join(known, "conversation"), "conversation")
    role = F.create_map(*(F.lit(x) for pair in (("u", "user"), ("a", "assistant"), ("s", "system")) for x in pair))
    return kept.select("conversation_id", F.explode("items").alias("x")).select("conversation_id", (F.col("x.g") + 1).cast("int").alias("turn"), "x.message_id", role[F.col("x.kind")].alias("role"))
