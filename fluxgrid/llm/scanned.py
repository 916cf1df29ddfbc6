"""Faults of text read from scanned pages, and its repair (problem 5).

Words and their counts come from all pages. A word's anagram value is the sum of its characters' values, so words
that differ in one place differ in value by the difference of what stands there. Rare and frequent words are
joined on their values less those of one or two neighbouring characters, which yields character confusions,
ranked by the number of words they explain. The differences of ranked confusions then are a table: a rare word is
wrongly read if its value and one or two of these differences make the value of a frequent word, and putting
the characters in place makes that word. Chinese has no spaces: there three
characters in a row take the part of the word. Headers, footers and page numbers are edge lines apart from
the even pitch of a page's body; cut words are found by their mark and by what follows in the body.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.llm.visual_form import with_visual_form
from fluxgrid.sources.scratch import cut

#: How much more frequent a word must be than a variant of it, for words and for Chinese characters in a row.
RATIO, RATIO_HAN = 5, 3
#: Least number of words that a confusion explains, and the least share of what the foremost one explains.
SUPPORT, SHARE = 4, 0.01
#: A gap this much larger or smaller than the page's pitch sets edge lines apart.
WIDE, NARROW = 1.25, 0.6
#: Page numbers of a series that are looked at together.
RANGE = 1_000

# Words after which a part ending in a hyphen was left open ("in- and output").
OPEN_ENDED = ["and", "or", "nor", "to", "und", "oder", "bis", "sowie", "bzw", "noch", "als"]

HAN = r"㐀-䶿一-鿿"
WORD = rf"[\p{{L}}\p{{N}}|&&[^{HAN}]]*[\p{{L}}\p{{N}}&&[^{HAN}]][\p{{L}}\p{{N}}|&&[^{HAN}]]*"
CUT = r"[\p{L}\p{N}|][-¬]\s*$"
HYPHENS = r"\s*[-¬]\s*$"
#: How a line looks that ends a sentence.
ENDS = r"""[.!?。！？…:：]["'”’)\]）]*\s*$"""


def ocr_lines(lines: DataFrame) -> DataFrame:
    """One row per page_id and line_no: text as read, looks (its visual form), x0, y0, soft.

    Repeated rows count once; of rows that differ the smallest counts. Null keys take no part, a null text
    is an empty line.
    """
    keyed = lines.where("page_id IS NOT NULL AND line_no IS NOT NULL")
    row = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0")))
    rows = keyed.groupBy("page_id", "line_no").agg(row.alias("r")).select("page_id", "line_no", "r.*")
    # A soft hyphen shows at a line's end only, the one place where it is kept.
    shown = F.regexp_replace("text", r"­\s*$", "-")
    rows = with_visual_form(rows.withColumn("looks", shown), "looks", "looks")
    return rows


def placed_lines(rows: DataFrame) -> DataFrame:
    """``rows`` with running (an edge line), and for body lines the body lines before and after, across pages.

    Adds ws (words), before and after (line_no, page_id, looks). Pages follow each other if their ids end in
    consecutive numbers after the same beginning.
    """
    page = Window.partitionBy("page_id")
    down = page.orderBy("line_no")
    rows = rows.withColumn("nth", F.row_number().over(down)).withColumn("gap", F.col("y0") - F.lag("y0").over(down)).withColumn("gap_below", F.lead("y0").over(down) - F.col("y0"))
    # Copies of a page have the same forms: of lines with the two around them on either side.
    around = [F.coalesce(f("looks", n).over(down), F.lit("\n")) for f in (F.lag, F.lead) for n in (1, 2)]
    rows = cut(rows.withColumn("form", F.xxhash64("looks", *around)), "lines")
    usual = rows.agg(F.percentile_approx("gap", 0.5, 1000).alias("usual"))
    pitches = rows.groupBy("page_id").agg(F.percentile_approx("gap", 0.5, 100).alias("own"), F.count("gap").alias("gaps"))
    pitches = pitches.join(usual).select("page_id", F.when(F.col("gaps") >= 4, F.col("own")).otherwise(F.col("usual")).alias("pitch"))
    rows = rows.join(pitches, "page_id")
    last_head = F.max(F.when((F.col("nth") <= 2) & (F.col("y0") < 0.2) & (F.col("gap_below") > WIDE * F.col("pitch")), F.col("nth"))).over(page)
    apart = (F.col("gap") > WIDE * F.col("pitch")) | (F.col("gap") < NARROW * F.col("pitch"))
    first_foot = F.min(F.when((F.col("y0") >= 0.8) & apart, F.col("nth"))).over(page)
    rows = rows.withColumn("running", (F.col("nth") <= F.coalesce(last_head, F.lit(0))) | F.coalesce(F.col("nth") >= first_foot, F.lit(False)))
    rows = rows.withColumn("series", F.regexp_extract("page_id", r"^(.*?)(\d+)$", 1)).withColumn("number", F.regexp_extract("page_id", r"(\d+)$", 1).try_cast("long"))
    rows = cut(rows.select("page_id", "line_no", "series", "number", "looks", "x0", "running", "form", words(F.col("looks")).alias("ws")), "placed")
    body = rows.where("NOT running")
    ends = body.where("number IS NOT NULL").groupBy("series", "number").agg(
        F.min(F.struct("line_no", "page_id", "looks")).alias("first"), F.max(F.struct("line_no", "page_id", "looks")).alias("last")
    )
    ahead = ends.select("series", (F.col("number") - 1).alias("number"), F.col("first").alias("next"))
    back = ends.select("series", (F.col("number") + 1).alias("number"), F.col("last").alias("previous"))
    inside = Window.partitionBy("page_id").orderBy("line_no")
    other = lambda f, page: f(F.struct("line_no", "page_id", "looks")).over(inside)
    body = body.withColumn("after", other(F.lead, 1)).withColumn("before", other(F.lag, 1))
    body = body.join(ahead, ["series", "number"], "left").join(back, ["series", "number"], "left")
    body = body.withColumn("after", F.coalesce("after", "next")).withColumn("before", F.coalesce("before", "previous")).drop("next", "previous")
    edge = rows.where("running").select(*rows.columns, *(F.lit(None).cast(body.schema[c].dataType).alias(c) for c in ("after", "before")))
    return body.select(*rows.columns, "after", "before").unionByName(edge)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def is_cut(text: Column, following: Column) -> Column:
    """Whether a line's last word is cut by a mark and goes on in the following body line."""
    open_ended = rf"(?i)^\W*({'|'.join(OPEN_ENDED)})(?![-\p{{L}}\p{{N}}])"  # "pick-", "and-place" goes on
    return F.coalesce(text.rlike(CUT) & following.rlike(r"^\W*[\p{L}\p{N}|]") & ~following.rlike(open_ended), F.lit(False))


def tokens(placed: DataFrame) -> DataFrame:
    """Words of all lines: page_id, line_no, left, right, w and, for a cut word, next_page and next_line.

    A word that is cut stands once, with its two parts in left and right and put together in w.
    """
    after, before = F.col("after.looks"), F.col("before.looks")
    goes_on = is_cut(F.col("looks"), after)
    begun = is_cut(before, F.col("looks"))
    rows = placed.select("page_id", "line_no", "ws", goes_on.alias("goes_on"), begun.alias("begun"), F.when(goes_on, F.regexp_extract(F.lower(after), WORD, 0)).alias("right"), F.col("after.page_id").alias("next_page"), F.col("after.line_no").alias("next_line"))
    first, size = F.when(F.col("begun"), 2).otherwise(1), F.size("ws")
    last = F.when(F.col("goes_on"), size - 1).otherwise(size)
    rows = rows.withColumn("plain", F.when(last >= first, F.slice("ws", first, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.array().cast("array<string>")))
    # The only word of a line may be the middle of a word cut twice; it counts with the part that it ends.
    whole = F.when(F.col("goes_on") & (size > 0), F.array(F.struct(F.element_at("ws", -1).alias("left"), F.col("right").alias("right"))))
    plain = F.transform("plain", lambda w: F.struct(w.alias("left"), F.lit(None).cast("string").alias("right")))
    out = rows.select("page_id", "line_no", "next_page", "next_line", F.explode(F.concat(plain, F.coalesce(whole, F.array().cast("array<struct<left:string,right:string>>")))).alias("t"))
    out = out.select("page_id", "line_no", "next_page", "next_line", "t.left", "t.right")
    return out.withColumn("w", F.concat("left", F.coalesce("right", F.lit(""))))


def witnesses(placed: DataFrame) -> DataFrame:
    """``placed`` with one line for each form: copies of a page are one witness of how often a word occurs."""
    several = placed.groupBy("form").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "line_no")).alias("first")).where("n > 1").select("form", "first")
    return placed.join(several, "form", "left").where("first IS NULL OR (first.page_id = page_id AND first.line_no = line_no)").drop("first")


def _value(text: str) -> str:
    """SQL of the anagram value of ``text``: the sum of its characters' values of 40 bits, alike for any order of them."""
    return f"aggregate(split({text}, ''), 0L, (s, c) -> s + CASE WHEN c = '' THEN 0L ELSE pmod(xxhash64(c), 1099511627776L) END)"


def _windows(types: DataFrame, least_rest: int) -> DataFrame:
    """Every way to take one or two neighbouring characters out of a word: m and where it stands, at."""
    spans = F.expr("flatten(transform(sequence(1, 2), k -> transform(sequence(1, greatest(length(w) - k + 1, 1)), i -> struct(i AS i, k AS k))))")
    out = types.withColumn("s", F.explode(spans)).where(f"s.i + s.k - 1 <= length(w) AND length(w) - s.k >= {least_rest}")
    return out.selectExpr("*", "s.i AS at", "substr(w, s.i, s.k) AS m").drop("s")


def confusions(types: DataFrame) -> DataFrame:
    """Ranked character confusions of a vocabulary (w, n): a, b, support.

    Rare and frequent words are joined on the anagram value of what is left without the differing characters,
    at least four, so that few words share it; a confusion counts alike in both directions.
    """
    valued = types.where(rf"length(w) >= 5 AND NOT w RLIKE '^[0-9]+$'").withColumn("value", F.expr(_value("w")))
    parts = _windows(valued, 4).withColumn("rest", F.expr(f"value - {_value('m')}")).drop("value")
    meant = parts.where(r"NOT w RLIKE '[0-9|]' AND n >= 3").select("rest", F.col("w").alias("word"), F.col("n").alias("often"), F.col("m").alias("b"), F.col("at").alias("there"))
    pairs = parts.withColumnRenamed("m", "a").join(meant, "rest").where(f"at = there AND a <> b AND often >= {RATIO} * n")
    pairs = pairs.where("substr(w, 1, at - 1) = substr(word, 1, at - 1) AND substr(w, at + length(a)) = substr(word, at + length(b))")
    # The differing characters are the least ones: neither a common first nor a common last character.
    pairs = pairs.where("(length(a) = 1 AND length(b) = 1) OR (left(a, 1) <> left(b, 1) AND right(a, 1) <> right(b, 1))")
    ranked = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.countDistinct("w").alias("support"))
    foremost = ranked.agg(F.max("support").alias("most"))
    return ranked.join(foremost).where(f"support >= {SUPPORT} AND support >= {SHARE} * most").select("a", "b", "support")


def corrections(types: DataFrame, ranked: DataFrame) -> DataFrame:
    """w, meant: words that up to two ranked confusions turn into a much more frequent word, with the best such word.

    Words meet on their anagram values and the differences that the confusions make: with one of them the value
    of the rare word is that of the frequent one, with two they meet half way. Whether the characters stand in
    the right places is looked at only then. The fewest confusions win, then the best ranked, then the most
    frequent word.
    """
    ways = ranked.select(F.col("a").alias("m"), F.col("b").alias("to"), "support").unionByName(ranked.select(F.col("b").alias("m"), F.col("a").alias("to"), "support"))
    ways = cut(ways.withColumn("gain", F.expr(f"{_value('to')} - {_value('m')}")), "differences")
    valued = cut(types.withColumn("value", F.expr(_value("w"))), "values")
    meant = valued.where(r"NOT w RLIKE '[0-9|]' AND n >= 3").select(F.col("w").alias("x"), F.col("n").alias("often"), "value")
    open_ = valued.where(r"length(w) >= 3 OR (length(w) = 2 AND w RLIKE '[0-9|]')").where(r"NOT w RLIKE '^([0-9]+|(xc|xl|l?x{0,3})(ix|iv|v?i{0,3}))$'")
    probes = _windows(open_, 0).drop("at").distinct().join(ways, "m").select("w", "n", "m", "to", "support", (F.col("value") + F.col("gain")).alias("value"))
    put = "concat(substr({y}, 1, i - 1), {to}, substr({y}, i + length({m})))"
    places = "filter(sequence(1, greatest(length({y}) - length({m}) + 1, 1)), i -> substr({y}, i, length({m})) = {m})"
    once = f"exists({places.format(y='w', m='m')}, i -> {put.format(y='w', to='to', m='m')} = x)"
    best = lambda hits: cut(hits.groupBy("w").agg(F.max(F.struct("rank", "often", "x")).alias("best")).select("w", F.col("best.x").alias("meant")), "hits")
    first = best(probes.join(meant, "value").where(f"often >= {RATIO} * n").where(once).withColumn("rank", F.col("support")))
    # From the other side: what a frequent word was before its last confusion.
    undone = _windows(meant.withColumnRenamed("x", "w"), 0).drop("at").distinct().withColumnRenamed("m", "to").join(ways, "to")
    undone = undone.select(F.col("w").alias("x"), "often", F.col("m").alias("m2"), F.col("to").alias("to2"), F.col("support").alias("support2"), (F.col("value") - F.col("gain")).alias("value"))
    pairs = probes.join(first, "w", "left_anti").join(undone, "value").where(f"often >= {RATIO} * n")
    middle = f"transform({places.format(y='w', m='m')}, i -> {put.format(y='w', to='to', m='m')})"
    twice = f"exists({middle}, y -> exists({places.format(y='y', m='m2')}, i -> {put.format(y='y', to='to2', m='m2')} = x))"
    second = best(pairs.where(twice).withColumn("rank", F.least("support", "support2")))
    return first.unionByName(second)


def misread_words(placed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wrongly read words and numbers: where they stand, what to put there, and which cut words keep their hyphen.

    (page_id, line_no) of the lines, (page_id, line_no, w, meant) of the corrections, a cut word as a whole at
    the line where it begins, and (page_id, line_no) of lines whose cut word is a compound with a hyphen.
    """
    # Words are counted where they stand and never written; only those of wrong ones are looked up again.
    types = tokens(witnesses(placed)).groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("right").isNull()).alias("alone"))
    types = cut(types, "types")
    ranked = cut(confusions(types), "ranked")
    wrong = cut(corrections(types, ranked), "wrong")
    # A number is wrongly read if all its other characters are ranked confusions of a digit.
    sign = ranked.where("length(a) = 1 AND length(b) = 1 AND (a RLIKE '[0-9]') <> (b RLIKE '[0-9]')")
    sign = sign.select(F.when(F.col("a").rlike("[0-9]"), F.col("b")).otherwise(F.col("a")).alias("c"), F.when(F.col("a").rlike("[0-9]"), F.col("a")).otherwise(F.col("b")).alias("d"), "support")
    sign = sign.groupBy("c").agg(F.max(F.struct("support", "d")).alias("best")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("c", "best.d"))).getField("c"), "").alias("from"), F.array_join(F.sort_array(F.collect_list(F.struct("c", "best.d"))).getField("d"), "").alias("to"))
    numbers = types.where(r"w RLIKE '[0-9]' AND NOT w RLIKE '^[0-9]+$'").join(sign).withColumn("meant", F.expr("translate(w, from, to)"))
    total = placed.agg(F.countDistinct("form").alias("lines"))
    numbers = numbers.where(r"meant RLIKE '^[0-9]+$'").join(total).where("n * 20 < lines").join(wrong.select("w"), "w", "left_anti").select("w", "meant")
    known = cut(wrong.unionByName(numbers), "known")
    single = cut(tokens(placed).where("right IS NULL").join(known, "w").select("page_id", "line_no", "w", "meant"), "single")
    # Of a cut word the parts are looked up by themselves only if together they are neither known nor a variant.
    good = types.where("n >= 3").join(wrong, "w", "left_anti").select("w")
    cuts = tokens(placed.where(is_cut(F.col("looks"), F.col("after.looks")))).where("right IS NOT NULL")
    cuts = cut(cuts.join(wrong, "w", "left").join(good.withColumn("known", F.lit(True)), "w", "left"), "cuts")
    both = cuts.where("meant IS NOT NULL")
    same = lambda a, b: F.expr(f"size(filter(sequence(1, least(length({a}), length({b}))), i -> substr({a}, 1, i) = substr({b}, 1, i)))")
    both = both.withColumn("ahead", same("w", "meant")).withColumn("behind", same("reverse(w)", "reverse(meant)"))
    upper = both.where("ahead < length(left)").select("page_id", "line_no")
    lower = both.where("behind < length(right)").select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"))
    apart = cuts.where("meant IS NULL AND known IS NULL").drop("w", "meant")
    named = wrong.where("length(w) >= 4")
    left = apart.withColumnRenamed("left", "w").join(named, "w").select("page_id", "line_no", "w", "meant")
    right = apart.withColumnRenamed("right", "w").join(named, "w").select(F.col("next_page").alias("page_id"), F.col("next_line").alias("line_no"), "w", "meant")
    # A hyphen was the word's own if its parts stand alone elsewhere and the whole never does.
    alone = types.where("alone >= 3").select("w")
    compound = cuts.join(alone, "w", "left_anti").join(alone.withColumnRenamed("w", "left"), "left", "left_semi").join(alone.withColumnRenamed("w", "right"), "right", "left_semi").select("page_id", "line_no").distinct()
    fixes = [single, both.select("page_id", "line_no", "w", "meant"), left]
    places = [x.select("page_id", "line_no") for x in (single, upper, lower, left, right)]
    return reduce(DataFrame.unionByName, places).distinct(), reduce(DataFrame.unionByName, fixes).distinct(), compound


def _han_rows(placed: DataFrame) -> DataFrame:
    """Three Chinese characters in a row: page_id, line_no, b, n, i, v, with those that run over from the lines around.

    ``i`` is their place in the ``b`` characters from the line before and the ``n`` of the line itself.
    """
    before = F.coalesce(F.regexp_extract("before.looks", ".{0,2}$", 0), F.lit(""))
    after = F.coalesce(F.regexp_extract("after.looks", "^.{0,2}", 0), F.lit(""))
    rows = placed.select("page_id", "line_no", F.length(before).alias("b"), F.length("looks").alias("n"), F.concat(before, "looks", after).alias("t"))
    rows = rows.selectExpr("page_id", "line_no", "b", "n", "explode(transform(sequence(1, greatest(length(t) - 2, 1)), i -> struct(i AS i, substr(t, i, 3) AS v))) AS s").select("page_id", "line_no", "b", "n", "s.i", "s.v")
    return rows.where(F.col("v").rlike(f"^[{HAN}]{{3}}$"))


def misread_han(placed: DataFrame) -> DataFrame:
    """(page_id, line_no, w, meant): wrongly read Chinese characters, each with its surroundings of three.

    Three characters in a row, across the lines of the body, are the words here. A confusion is trusted if
    the character meant gives a much more frequent row in at least half the surroundings of the character
    seen, by their number on the pages, whether that stands first, in the middle or last.
    """
    rows = lambda lines: _han_rows(lines.where(F.col("looks").rlike(f"[{HAN}]")))
    types = cut(rows(witnesses(placed)).where("i > b").groupBy("v").agg(F.count("*").alias("n")), "types")
    holes = types.selectExpr("v", "n", "explode(transform(sequence(1, 3), x -> struct(x AS x, substr(v, x, 1) AS c, substr(v, 1, x - 1) || '_' || substr(v, x + 1) AS rest))) AS s").select("v", "n", "s.*")
    meant = holes.where("n >= 3").select("rest", F.col("c").alias("a"), F.col("n").alias("often"))
    explained = holes.join(meant, "rest").where(f"c <> a AND often >= {RATIO_HAN} * n").groupBy("a", "c", "x").agg(F.sum("n").alias("k"), F.count("*").alias("kinds"))
    all_ = holes.groupBy("c", "x").agg(F.sum("n").alias("of"))
    seen = explained.select("a", "c").distinct().join(all_, "c")
    shares = seen.join(explained, ["a", "c", "x"], "left").groupBy("a", "c").agg(F.min(F.coalesce("k", F.lit(0)) / F.col("of")).alias("least"), F.sum(F.coalesce("k", F.lit(0))).alias("k"), F.sum("of").alias("of"), F.sum(F.coalesce("kinds", F.lit(0))).alias("kinds"))
    trusted = shares.where(f"least >= 0.5 AND k > 0.6 * of AND kinds >= {SUPPORT}").groupBy("c").agg(F.max(F.struct("k", "a")).alias("best")).select("c", F.col("best.a").alias("a"))
    trusted = cut(trusted, "trusted")
    table = trusted.agg(F.sort_array(F.collect_list(F.struct("c", "a"))).alias("l")).selectExpr("array_join(l.c, '') AS from", "array_join(l.a, '') AS to")
    often = types.select(F.col("v").alias("meant"), F.col("n").alias("often"))
    cases = holes.join(trusted, "c").join(table)
    cases = cases.withColumn("meant", F.explode(F.array_distinct(F.array(F.expr("replace(rest, '_', a)"), F.expr("translate(v, from, to)")))))
    cases = cases.join(often, "meant").where(f"often >= {RATIO_HAN} * n").groupBy("v", "x").agg(F.max(F.struct("often", "meant")).alias("best")).select("v", "x", F.col("best.meant").alias("meant"))
    hit = rows(placed).join(cut(cases, "cases"), "v").where("i + x - 1 > b AND i + x - 1 <= b + n")
    return hit.select("page_id", "line_no", F.col("v").alias("w"), "meant").distinct()


def faults(lines: DataFrame) -> DataFrame:
    """page_id, line_no, kind (hyphen, misread, running), one row per line and kind.

    Empty tables give no rows; null positions set no line apart; lines of empty text have no fault but may
    be running lines.
    """
    placed = cut(placed_lines(ocr_lines(lines)), "flow")
    running = placed.where("running").select("page_id", "line_no", F.lit("running").alias("kind"))
    hyphen = placed.where(is_cut(F.col("looks"), F.col("after.looks"))).select("page_id", "line_no", F.lit("hyphen").alias("kind"))
    found, _, _ = misread_words(placed)
    misread = found.unionByName(misread_han(placed).select("page_id", "line_no")).distinct()
    return running.unionByName(hyphen).unionByName(misread.withColumn("kind", F.lit("misread")))


def _fixed(text: Column) -> Column:
    """``text`` with the corrections of its line (fixes) applied to whole words, and to Chinese characters in their surroundings."""
    edge = r"[\\p{L}\\p{N}|]"
    word = lambda w: f"concat('(?<!{edge})\\\\Q', {w}, '\\\\E(?!{edge})')"
    capital = lambda w: f"concat(upper(left({w}, 1)), substr({w}, 2))"
    rule = f"""aggregate(coalesce(fixes, array()), looks, (t, f) -> CASE WHEN f.w RLIKE '[{HAN}]' THEN replace(t, f.w, f.meant)
        ELSE regexp_replace(regexp_replace(t, {word(capital('f.w'))}, {capital('f.meant')}), concat('(?i)', {word('f.w')}), f.meant) END)"""
    return F.expr(rule.replace("looks", "line_text"))


def _repaired(lines: DataFrame) -> DataFrame:
    """Body lines: page_id, line_no, series, number, looks, before, line_text (repaired), indented, paragraph of its page.

    A cut word stands whole in the line where it begins and is gone from the next; compounds that were cut at
    their own hyphen keep it. An indented line begins a paragraph.
    """
    placed = cut(placed_lines(ocr_lines(lines)), "flow")
    _, fixes, kept = misread_words(placed)
    fixes = fixes.unionByName(misread_han(placed)).groupBy("page_id", "line_no").agg(F.sort_array(F.collect_set(F.struct((-F.length("w")).alias("o"), "w", "meant"))).alias("fixes"))
    after, before = F.col("after.looks"), F.col("before.looks")
    rows = placed.where("NOT running").join(kept.withColumn("hyphen", F.lit("-")), ["page_id", "line_no"], "left").join(fixes, ["page_id", "line_no"], "left")
    first = rf"(?i)^\W*({WORD})"
    text = F.when(is_cut(before, F.col("looks")), F.regexp_replace("looks", first, "")).otherwise(F.col("looks"))
    goes_on = is_cut(F.col("looks"), after)
    text = F.when(goes_on, F.concat(F.regexp_replace(text, HYPHENS, ""), F.coalesce("hyphen", F.lit("")), F.regexp_extract(after, first, 1))).otherwise(text)
    rows = rows.withColumn("line_text", F.trim(text)).withColumn("line_text", _fixed(F.col("line_text")))
    page = Window.partitionBy("page_id")
    order = page.orderBy("line_no")
    rows = rows.withColumn("indented", F.coalesce(F.col("x0") > F.min("x0").over(page) + 0.015, F.lit(False)))
    return rows.withColumn("paragraph", F.sum(F.when(F.col("indented"), 1).otherwise(0)).over(order))


def _joined(rows: DataFrame, *place: str) -> DataFrame:
    """page_id, paragraph, text of rows with these; the lines of each in the order of ``place``.

    Lines are folded one by one, with what stands between them decided by their ends; those of Chinese are
    joined without a blank.
    """
    item = F.sort_array(F.collect_list(F.struct(*place, "line_text")))
    rows = rows.where("line_text <> ''").groupBy("page_id", "paragraph").agg(item.alias("items"))
    joined = f"""aggregate(items.line_text, '', (s, t) -> CASE WHEN s = '' THEN t WHEN t RLIKE '^[-,.;:!?)，。；：！？）]' OR s RLIKE '[{HAN}，。；：！？）]$' OR (t RLIKE '^[{HAN}]' AND s RLIKE '[{HAN}0-9]$') THEN concat(s, t) ELSE concat(s, ' ', t) END)"""
    return rows.select("page_id", F.col("paragraph").cast("int").alias("paragraph"), F.expr(joined).alias("text"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """page_id, paragraph, text: the body of each page, repaired, in paragraphs that end with the page.

    Edge lines are left out. Pages without a body have no rows.
    """
    return _joined(_repaired(lines), "line_no")


def _carried(starts: DataFrame) -> DataFrame:
    """page_id, begun (page_id, paragraph): for pages (page_id, series, number, goes_on, last) that go on, the paragraph they go on with.

    ``last`` is null where a page has only what it goes on with. A page that goes on follows the one before it
    without a gap, so the latest page with a paragraph of its own has it: a running maximum over ranges of pages.
    """
    own = F.when(F.col("last").isNotNull(), F.struct("number", "page_id", "last"))
    rows = cut(starts.withColumn("own", own).withColumn("range", F.floor(F.col("number") / RANGE)), "starts")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("series", "range").agg(F.max("own").alias("top"))
    ranges = ranges.withColumn("earlier", F.max("top").over(upto(Window.partitionBy("series").orderBy("range")))).drop("top")
    rows = rows.withColumn("within", F.max("own").over(upto(Window.partitionBy("series", "range").orderBy("number"))))
    begun = F.coalesce("within", "earlier")
    rows = rows.where("goes_on").join(ranges, ["series", "range"]).select("page_id", begun["page_id"].alias("begun_on"), begun["last"].alias("begun"))
    return rows.where("begun IS NOT NULL")


def flowing_paragraphs(lines: DataFrame) -> DataFrame:
    """page_id, paragraph, text: as ``paragraphs``, but whole across pages, named by the page on which each begins.

    A page goes on with the paragraph before it if its first body line is not indented and the last body line
    of the page before ends no sentence. Lines before the page's first indented one that end no sentence
    themselves are a title and go on with nothing, unless they complete a cut word. Where two page ids have the
    same number nothing is carried over.
    """
    rows = cut(_repaired(lines).select("page_id", "line_no", "series", "number", "line_text", "indented", "paragraph", "before", "looks"), "repaired")
    first = F.min(F.struct("line_no", "indented", "before", "looks"))
    closing = F.max(F.when(F.col("paragraph") == 0, F.struct("line_no", "looks")))
    pages = rows.groupBy("page_id", "series", "number").agg(first.alias("f"), closing["looks"].alias("closing"), F.min("paragraph").alias("top"), F.max("paragraph").alias("last"))
    before, looks = F.col("f.before"), F.col("f.looks")
    untitled = (F.col("top") == F.col("last")) | F.col("closing").rlike(ENDS)
    open_ = F.coalesce((before["page_id"] != F.col("page_id")) & (~before["looks"].rlike(ENDS) & untitled | is_cut(before["looks"], looks)), F.lit(False))
    pages = pages.where("number IS NOT NULL").withColumn("goes_on", open_ & ~F.col("f.indented"))
    alone = pages.groupBy("series", "number").agg(F.count("*").alias("n")).where("n = 1").select("series", "number")
    pages = cut(pages.join(alone, ["series", "number"]).select("page_id", "series", "number", "goes_on", "top", "last"), "pages")
    # The page before must be alone under its number as well.
    there = pages.select("series", (F.col("number") + 1).alias("number"), F.lit(True).alias("there"))
    pages = pages.join(there, ["series", "number"], "left").withColumn("goes_on", F.col("goes_on") & F.col("there").isNotNull())
    own = F.when(~(F.col("goes_on") & (F.col("top") == F.col("last"))), F.col("last"))
    carried = _carried(pages.select("page_id", "series", "number", "goes_on", own.alias("last"))).join(pages.select("page_id", F.col("top").alias("paragraph")), "page_id")
    rows = rows.join(carried, ["page_id", "paragraph"], "left")
    rows = rows.select(F.coalesce("begun_on", "page_id").alias("page_id"), F.coalesce("begun", "paragraph").alias("paragraph"), "number", "line_no", "line_text")
    return _joined(rows, "number", "line_no")
