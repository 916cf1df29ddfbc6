"""Texts that look the same, brought to one form (problem 1).

The form is computed by DuckDB inside Arrow partitions: Spark hands a task its rows as Arrow batches, the
task runs one embedded SQL expression over the text column, and the batch goes back with the form beside
it. The expression composes accents (NFC), drops characters that do not show, and maps width forms, kinds
of space, radicals, ligatures and letters of the same shape. What can be seen stays: case, accents, raised
digits, line breaks, the number of spaces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxgrid.sources.scratch import cut

# Ranges of characters that do not show.
INVISIBLE = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
    (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE01EF),
]

# Kinds of space.
SPACES = [0x0009, 0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]

# Letters and signs, and the character of the same shape that stands for them.
SAME_SHAPE = [
    # Cyrillic
    ("АВЕЅІЇЈКМНОРСТУХЁ", "ABESIÏJKMHOPCTYXË"),
    ("аеёорсухѕіїјһӓӧ", "aeëopcyxsiïjhäö"),
    ("ԁԛԝѵҮԌԜ", "dqwvYGW"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("οϲϳνρ", "ocjvp"),
    # Latin letters of other alphabets' use, Cherokee and Lisu
    ("ɡɑ", "ga"),
    ("ᎪᏴᏟᎠᎬᏀᎻᏆᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "ABCDEGHIJKLMPSTVWZ"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
    # Roman numerals of one letter
    ("ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ", "IVXLCDMivxlcdm"),
    # signs
    ("µΩÅK‐‑﹣⁃∶˸․‚⁄", "μΩÅK----::.,/"),
]

# Single characters drawn as several.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("℃", "°C"), ("℉", "°F"), ("Ⅱ", "II"), ("Ⅲ", "III"), ("Ⅳ", "IV"), ("Ⅵ", "VI"), ("Ⅶ", "VII"), ("Ⅷ", "VIII"), ("Ⅸ", "IX"), ("Ⅺ", "XI"), ("Ⅻ", "XII")]

#: Blocks whose characters differ from their compatibility form in width or code only: Kangxi and other
#: radicals, ideographs kept for compatibility, full- and half-width forms.
COMPATIBLE = [(0x2E80, 0x2FD6), (0xF900, 0xFB00), (0xFF01, 0xFFE7)]


@lru_cache(maxsize=1)
def character_maps() -> tuple[dict[str, str], dict[str, str]]:
    """One character to the one that is kept for it: those met all the time, and all of them."""
    common = {chr(code): chr(code - 0xFEE0) for code in range(0xFF01, 0xFF5F)} | {chr(code): " " for code in SPACES}
    for seen, kept in SAME_SHAPE:
        common |= dict(zip(seen, kept, strict=True))
    whole: dict[str, str] = {}
    for low, high in COMPATIBLE:
        for code in range(low, high):
            kept = unicodedata.normalize("NFKC", chr(code))
            if len(kept) == 1 and kept != chr(code) and kept != " ":
                whole[chr(code)] = kept
    whole |= {"ﾞ": "゙", "ﾟ": "゚"}  # half-width voicing marks compose with what they follow
    whole |= common
    for seen, kept in [*whole.items()]:  # a full-width form of a look-alike ends where the look-alike ends
        whole[seen] = whole.get(kept, kept)
    return {c: whole[c] for c in common}, whole


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _class(codes: list[int]) -> str:
    """A regular expression's class of code points, neighbours joined to ranges."""
    ranges: list[list[int]] = []
    for code in sorted(set(codes)):
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in ranges) + "]"


@lru_cache(maxsize=8)
def form_sql(column: str) -> str:
    """The DuckDB expression of the form of ``column``; null stays null.

    DuckDB's ``translate`` sets up its map anew for every row, so a text goes through the smallest map that
    has all of its characters.
    """
    common, whole = character_maps()
    hidden = [code for low, high in INVISIBLE for code in range(low, high + 1)]
    rare = [13, *(ord(c) for c in whole if c not in common), *(ord(c) for c, _ in LIGATURES)]

    def mapped(text: str, chars: dict[str, str]) -> str:
        text = f"regexp_replace({text}, '{_class(hidden)}', '', 'g')"
        return f"nfc_normalize(translate(nfc_normalize({text}), {_quoted(''.join(chars))}, {_quoted(''.join(chars.values()))}))"

    full = f"replace({column}, chr(13) || chr(10), chr(10))"
    for seen, kept in LIGATURES:
        full = f"replace({full}, {_quoted(seen)}, {_quoted(kept)})"
    return f"""CASE WHEN NOT regexp_matches({column}, '{_class([*hidden, *rare, *map(ord, common)])}') THEN nfc_normalize({column})
        WHEN NOT regexp_matches({column}, '{_class(rare)}') THEN {mapped(column, common)}
        ELSE {mapped(full, whole)} END"""


def _with_form(text: str, out: str, query: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "autoinstall_known_extensions": False})
    for batch in batches:
        con.register("rows", pa.table({"t": batch.column(text)}))
        form = con.sql(query).to_arrow_table().column(0).combine_chunks().cast(pa.string())
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != out]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), form], [*(n for n, _ in kept), out])
    con.close()


def with_visual_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """``df`` with the one consistent form of ``text`` in ``out``.

    Null gives null, the empty text gives itself, long texts are taken whole; repeated rows stay repeated.
    A column already called ``out`` is replaced, all others pass through.
    """
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType())])
    query = f"SELECT {form_sql('t')} AS f FROM rows"
    return df.mapInArrow(lambda batches: _with_form(text, out, query, batches), schema)


def digest(text: str | Column) -> Column:
    """128 bits that stand for a text in joins, so that the text itself needn't be shuffled."""
    c = F.col(text) if isinstance(text, str) else text
    return F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))


def look_alike_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, form, text, copies, texts: each record with digests of its form and its text.

    ``form`` is the class of all records that look the same, ``text`` that of exact copies within it; ``copies``
    counts the records of the text, ``texts`` the different texts of the form. The result has one row per record
    however large a class is; ``look_alike_pairs`` spreads it to pairs. Rows with a null key or text take no
    part; repeated rows count once.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("t")).where("key IS NOT NULL AND t IS NOT NULL")
    rows = with_visual_form(rows, "t", "f").select("key", digest("f").alias("form"), digest("t").alias("text"))
    # Written once: everything below reads these hashes and keys, not the texts again.
    rows = cut(rows.distinct(), "forms")
    texts = rows.groupBy("form", "text").agg(F.count("*").alias("copies"))
    sizes = texts.groupBy("form").agg(F.count("*").alias("texts"))
    return rows.join(texts.join(sizes, "form"), ["form", "text"]).select("key", "form", "text", "copies", "texts")


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key_a < key_b`` of records whose texts differ and look the same: the expansion of ``look_alike_classes``.

    Copies of one text are never compared with each other: texts are paired first, by their form, and only then
    spread to the keys that carry them, so the work follows the size of the result even if a third of all rows
    share a text. An empty table gives no pairs.
    """
    kept = look_alike_classes(df, key, text).where("texts > 1").select(F.col("key").alias("k"), F.col("form").alias("f"), F.col("text").alias("t"))
    texts = kept.select("f", "t").distinct()
    a, b = texts.select("f", F.col("t").alias("ta")), texts.select("f", F.col("t").alias("tb"))
    pairs = a.join(b, "f").where("ta < tb").drop("f")
    pairs = pairs.join(kept.select(F.col("t").alias("ta"), F.col("k").alias("ka")), "ta").join(kept.select(F.col("t").alias("tb"), F.col("k").alias("kb")), "tb")
    return pairs.where("ka <> kb").select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()
