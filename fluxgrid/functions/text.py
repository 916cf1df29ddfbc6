"""Scalar text functions, all of them expressions of the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# White space other than line breaks.
BLANKS = r" \t\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}"

# How lines of a page look that are more than running text.
PATTERNS = {
    "numbered": r"^(\d+(\.\d+){0,5})(\s+|(?=[一-鿿A-Za-z]))",
    "chapter": r"^第[一二三四五六七八九十百]+[章节部分]",
    "appendix": r"^附录\s*[A-ZＡ-Ｚ0-9一二三四五六七八九十]+(\s|$)",
    "list_item": r"^([-•●▪]|\(?[a-zA-Z0-9一二三四五六七八九十]+[)）、.])\s+",
    "table_caption": r"(?i)^(表|Table)\s*\d+[A-Za-z0-9.（）()\-]*(\s|$)",
    "figure_caption": r"(?i)^(图|Figure|Fig\.)\s*\d+[A-Za-z0-9.（）()\-]*(\s|$)",
    "page_number": r"(?i)^(\d{1,4}|[ivxlcdm]{1,8}|[A-Z]-?\d{1,4})$",
    "formula": r"([A-Za-zΑ-ω]\s*=|[≤≥≈±∑√]|\d\s*[+×÷/]\s*\d)",
    "list_sentence": r"^([a-zA-Z]|\d+)[)）]\s*",
    "unit": r"(?i)(N/mm|mm/s|mm×mm|°C|℃|%RH|\d\s*%|[≤≥≈±]|\d\s*[=~～]\s*\d)",
    "sentence_end": r"[。；;：:，,！？!?]$",
    "leader": r"(…{2,}|\.{4,})",
    "label": r"(?i)^(Sponsored by|Advertisement)$",
}

# What viewers leave in a text layer, as a piece of its own and within one.
OVERLAYS = [r"(?i)^page\s*\(\s*\d+\s*/\s*\d+\s*\)$", r"^100%$", r"^-?\s*100%\s*\+?$"]
OVERLAY_INLINE = r"(?i)([-+]?\s*100%\s*[-+]?|\+?\s*page\s*\(\s*\d+\s*/\s*\d+\s*\))"


def normalize(text: Column) -> Column:
    """No NUL, LF line ends, single blanks, trimmed lines, at most one empty line in a row, trimmed."""
    text = F.regexp_replace(F.regexp_replace(text, r"\x00", ""), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), rf"[{BLANKS}]*\n[{BLANKS}]*", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), rf"^[\n{BLANKS}]+|[\n{BLANKS}]+$", "")


def match_form(case: bool = True):
    """Pandas UDF: a text in compatibility form (NFKC), without case unless ``case`` is false, single blanks, trimmed.

    The JVM has no such function for columns; texts pass through it in Arrow batches. Null stays null.
    """

    @pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            text = batch.str.normalize("NFKC")
            yield (text.str.casefold() if case else text).str.replace(r"\s+", " ", regex=True).str.strip()

    return form


def single_line(text: Column) -> Column:
    """All white space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, rf"[\r\n{BLANKS}]+", " "))


def quality_flags(text: Column, least: int = 80, replaced: float = 0.01) -> Column:
    """empty_text, low_text, replacement_characters, control_characters, as an array."""
    size, odd = F.length(text), F.length(text) - F.length(F.regexp_replace(text, "�", ""))
    flags = [
        F.when(size == 0, F.lit("empty_text")).when(size < least, F.lit("low_text")),
        F.when(odd / F.greatest(size, F.lit(1)) > replaced, F.lit("replacement_characters")),
        F.when(text.rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]"), F.lit("control_characters")),
    ]
    return F.array_compact(F.array(*flags))


def assessment(flags: Column) -> Column:
    return F.when(F.array_contains(flags, "empty_text"), "fail").when(F.size(flags) > 0, "warn").otherwise("pass")


def table_likeness(text: Column) -> Column:
    """How much lines look like rows: the words with a digit of lines with two or more of them, and two for a tab or a wide gap."""
    numbers = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w.rlike(r"\d")))
    score = lambda x: F.when(numbers(x) >= 2, numbers(x)).otherwise(0) + F.when(x.contains("\t") | x.contains("  "), 2).otherwise(0)
    return F.aggregate(F.split(text, "\n"), F.lit(0), lambda s, x: s + score(x))


def without_overlays(text: Column) -> Column:
    """Lines without what viewers leave in them: pieces between bars that are overlays, and overlays inside the others."""

    def line(x: Column) -> Column:
        pieces = F.transform(F.split(x, r"\|"), lambda p: F.trim(p))
        kept = F.filter(pieces, lambda p: ~p.rlike("|".join(f"({o})" for o in OVERLAYS)))
        kept = F.transform(kept, lambda p: F.regexp_replace(F.regexp_replace(p, OVERLAY_INLINE, ""), r"^[ +\-|]+|[ +\-|]+$", ""))
        return F.array_join(F.filter(kept, lambda p: p != ""), " | ")

    lines = F.filter(F.transform(F.split(normalize(text), "\n"), line), lambda x: x != "")
    return normalize(F.array_join(lines, "\n"))


def contains_term(text: Column, term: Column) -> Column:
    """A term of letters or digits stands alone; any other is a part of the text. Both in lower case."""
    quoted = F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    alone = F.regexp_like(text, F.concat(F.lit("(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)")))
    return F.when(term.rlike("[a-z0-9]"), alone).otherwise(F.contains(text, term))


def holds_term(text: Column, term: str) -> Column:
    """``contains_term`` of one known term, whose pattern is compiled once; a plain search goes before it."""
    found = F.contains(text, F.lit(term))
    if not re.search("[a-z0-9]", term):
        return found
    quoted = re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", term)
    return found & text.rlike(f"(^|[^a-z0-9]){quoted}([^a-z0-9]|$)")


def heading(text: Column, longest: int = 100) -> Column:
    """struct(accepted, level, reason) of a line that may be a heading; the first rule that holds decides."""
    t, p = single_line(text), PATTERNS
    number = F.regexp_extract(t, r"^([1-9]\d*(\.\d+){0,5})(\s*)(.+)$", 1)
    gap, title = F.regexp_extract(t, r"^([1-9]\d*(\.\d+){0,5})(\s*)(.+)$", 3), F.regexp_extract(t, r"^([1-9]\d*(\.\d+){0,5})(\s*)(.+)$", 4)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    others = F.length(F.regexp_replace(t, r"[\p{L}\s]", ""))
    no = lambda reason: F.struct(F.lit(False).alias("accepted"), F.lit(None).cast("int").alias("level"), F.lit(reason).alias("reason"))
    yes = lambda level, reason: F.struct(F.lit(True).alias("accepted"), level.cast("int").alias("level"), F.lit(reason).alias("reason"))
    return (
        F.when(F.length(t) < 3, no("too_short"))
        .when(F.length(t) > longest, no("too_long"))
        .when(F.contains(t, F.lit("|")), no("table_row"))
        .when(t.rlike(p["leader"]), no("toc_entry"))
        .when(t.rlike(p["label"]), no("generic_label"))
        .when(t.rlike(p["list_sentence"]), no("list_sentence"))
        .when(t.rlike(p["unit"]), no("parameter_expression"))
        .when(t.rlike(p["sentence_end"]), no("sentence"))
        .when((number != "") & (F.regexp_extract(number, r"^\d+", 0).try_cast("long") > 99), no("numeric_noise"))
        .when((number != "") & ~title.rlike(r"^\p{L}"), no("numeric_noise"))
        .when((number != "") & (gap == "") & title.rlike(r"^[A-Za-z]"), no("numeric_noise"))
        .when((number != "") & title.rlike(r"^[a-z]"), no("sentence"))
        .when(number != "", yes(F.least(F.length(number) - F.length(F.regexp_replace(number, r"\.", "")) + 1, F.lit(6)), "numbered_heading"))
        .when(t.rlike(p["chapter"]) | t.rlike(p["appendix"]), yes(F.lit(1), "named_heading"))
        .when(letters < 2, no("insufficient_letters"))
        .when(others > 0.35 * F.length(t), no("numeric_noise"))
        .otherwise(yes(F.lit(1), "unnumbered_heading"))
    )


def block_type(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, font: Column, typical: Column, header: float = 0.08, footer: float = 0.92) -> Column:
    """Kind of a layout line by place, form and size; the first rule that holds decides."""
    t, p, size = F.trim(text), PATTERNS, F.length(F.trim(text))
    large = size.between(4, 100) & ~F.contains(t, F.lit(" | ")) & (x1 - x0 >= 0.12) & (typical > 0) & (font >= typical * 1.5) & t.rlike(r"\p{L}")
    capitals = size.between(8, 100) & t.rlike(r"^[^a-zäöüß]*$") & t.rlike(r"[A-Z]{2,}[^A-Z]+(.*[^A-Z])?[A-Z]{2,}")
    return (
        F.when(t.rlike(p["page_number"]) & ((y0 >= 0.88) | (y1 <= 0.12)), "page_number")
        .when(y1 <= header, "header")
        .when(y0 >= footer, "footer")
        .when(t.rlike(p["table_caption"]), "table_caption")
        .when(t.rlike(p["figure_caption"]), "figure_caption")
        .when(t.rlike(p["numbered"]) | t.rlike(p["chapter"]) | large | capitals, "heading")
        .when(t.rlike(p["list_item"]), "list_item")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when((size <= 160) & t.rlike(p["formula"]), "formula")
        .otherwise("paragraph")
    )


def page_number(page: Column) -> Column:
    """A page number with at least four digits."""
    return F.format_string("%04d", page)


def terms(text: Column) -> Column:
    """Lower-case words of letters and digits; Chinese characters in pairs."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9äöüß]+"), F.lit(0))
    han = F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]", "")
    # Bound by a lambda, so that the characters are taken out once and not for every pair.
    pairs = F.flatten(F.transform(F.array(han), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.length(h) - 1, F.lit(1))), lambda i: F.substring(h, i, F.lit(2)))))
    pairs = F.filter(pairs, lambda p: F.length(p) == 2)
    return F.concat(words, pairs)


def chunk_id(source: Column, pages: Column, text: Column, digits: int = 24) -> Column:
    """Content-addressed id: the hash of the canonical JSON of what makes the chunk, keys in order, no blanks."""
    body = F.to_json(F.struct(pages.alias("page_ids"), source.alias("source_id"), F.sha2(text, 256).alias("text_hash")))
    return F.concat(source, F.lit(":c_"), F.substring(F.sha2(body, 256), 1, digits))


def uuid5(name: Column, namespace: str) -> Column:
    """UUID version 5 of a name within a namespace (32 hex digits)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*(F.lit(c) for c in "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
