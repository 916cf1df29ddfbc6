"""Text quality statistics per document and the tails of their distributions (problem 8).

Tasks count characters, words and marks of every line of every document with Arrow's regular expressions
and sum them up by document. Spark builds mergeable KLL quantile sketches of each statistic per language;
values become percentiles and robust z-scores, and documents in the tail of a distribution are flagged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.sources.scratch import cut

# Words and signs that hold sentences together; articles, which lists have too, are left out.
ENGLISH = "about after although and are as at be because been before both but by did do does during each every few for from had has have if in instead into is it its may most must neither nor not of on once only or other our should since so some such than that their then there these they this those to under until was we were what when whenever where which while who will with would you".split()
GERMAN = "als am an auch auf aus bei bis da damit dass dem den deren des diese dieser dieses durch ein eine einem einen einer eines er erst es für hat hatte ihre im in ist jedes jedoch keine können mit nach nicht noch nur ob obwohl oder ohne sagen seine sich sie sind sobald sollte um und unter von vor war waren weil wenn werden wie wird wurde wurden während zu zugleich zum zur zwischen über".split()
CHINESE = "的了在是与而但就被把将再仍由这那也都并且若则之所因为，。；"

#: Share of the words, or of the Chinese characters, from which a line reads as part of a sentence.
BOUND, BOUND_HAN = 0.08, 0.04
#: One-sided robust z-score from which a value lies in a tail.
TAIL = 3.0

#: Share of the characters outside sentences from which a text is flagged whatever the others of its language are.
STRAY = 0.5

#: Statistics, the side of their tail that speaks against prose (0: both) and the least scale of a z-score.
STATISTICS = {"words": (0, 1.0), "mean_word_length": (0, 0.2), "symbol_ratio": (1, 0.01), "end_share": (-1, 0.02), "common_share": (-1, 0.02), "stray_share": (1, 0.02)}

_SPACE = r"[\s\x{A0}\x{2000}-\x{200B}\x{3000}]"


def _words(words: list[str]) -> str:
    return rf"(?i)(?:^|\P{{L}})(?:{'|'.join(words)})\b"


PATTERNS = {
    "letters": r"\p{L}",
    "numbers": r"\p{N}",
    "space": _SPACE,
    "marks": r"""[.,;:!?'"()\-。，、；：！？“”‘’„（）%°/]""",
    "han": r"\p{Han}",
    "words": r"\p{Latin}+",
    "english": _words(ENGLISH),
    "german": _words(GERMAN),
    "chinese": f"[{CHINESE}]",
    "ends": rf"""[.!?。！？…:：]["'”’)\]]*{_SPACE}*$""",
    "columns": r"\||;|\t|\S {2,}\S",
    "bullet": rf"^{_SPACE}*(?:[*•●▪‣·–-]|\p{{N}}{{1,3}}[.)、]|[A-Za-z]\)){_SPACE}",
}


def _counted(batches: Iterator[pa.RecordBatch], patterns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """key, text to key and the statistics of each text."""
    for batch in batches:
        text = pc.replace_substring_regex(batch.column(1), r"\r\n?", "\n")
        lines = pc.split_pattern(text, "\n")
        doc = np.repeat(np.arange(len(lines)), np.diff(lines.offsets.to_numpy()))
        flat = lines.flatten()
        if isinstance(flat, pa.ChunkedArray):
            flat = flat.combine_chunks()
        length = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        shown = length > pc.count_substring_regex(flat, patterns["space"]).to_numpy(zero_copy_only=False)
        flat, doc, length = flat.filter(pa.array(shown)), doc[shown], length[shown]
        c = {name: pc.count_substring_regex(flat, p).to_numpy(zero_copy_only=False).astype(np.int64) for name, p in patterns.items()}
        size = len(lines)
        total = lambda x: np.bincount(doc, weights=x, minlength=size).astype(float)
        common = np.maximum(c["english"], c["german"])
        bound = ((common >= 1) & (common >= BOUND * c["words"]) & (c["words"] >= 2)) | ((c["han"] >= 4) & (c["chinese"] >= np.maximum(1, BOUND_HAN * c["han"])))
        # A line without such words still belongs to a sentence that runs on around it.
        plain = (c["columns"] == 0) & (c["bullet"] == 0) & (c["letters"] * 2 > length)
        up = np.zeros(len(doc), bool)
        up[1:] = bound[:-1] & (doc[1:] == doc[:-1])
        down = np.zeros(len(doc), bool)
        down[:-1] = bound[1:] & (doc[1:] == doc[:-1])
        first = np.ones(len(doc), bool)
        first[1:] = doc[1:] != doc[:-1]
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        heading = first & ~last & plain & (c["ends"] == 0) & (length <= 60) & (c["letters"] + c["space"] >= 0.9 * length)
        kept = bound | (plain & up & (down | (c["ends"] > 0))) | (plain & down & first) | heading
        letters, chars, words = total(c["letters"]), total(length), total(c["words"] + c["han"])
        part = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
        han, english, german = total(c["han"]), total(c["english"]), total(c["german"])
        symbols = total(np.maximum(length - c["letters"] - c["numbers"] - c["space"] - c["marks"], 0))
        language = np.where(han > 0.3 * letters, "zh", np.where(german > english, "de", np.where(english > 0, "en", "")))
        out = {
            "key": batch.column(0),
            "language": pa.array([x or None for x in language.tolist()], pa.string()),
            "chars": pa.array(chars.astype(np.int64)),
            "lines": pa.array(total(np.ones(len(doc))).astype(np.int64)),
            "words": pa.array(words),
            "mean_word_length": pa.array(part(letters, total(c["words"] + c["han"]))),
            "symbol_ratio": pa.array(part(symbols, chars)),
            "end_share": pa.array(part(total(c["ends"] > 0), total(np.ones(len(doc))))),
            "common_share": pa.array(part(total(np.where(c["han"] * 2 > c["letters"], c["chinese"], common)), words)),
            "stray_share": pa.array(part(total(np.where(kept, 0, length)), chars)),
        }
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _declared(lang: Column) -> Column:
    """en, de or zh from the many ways to write a language; anything else in lower case."""
    code = F.lower(F.trim(lang))
    for short, names in {"en": "en|eng|english", "de": "de|ger|deu|german|deutsch", "zh": "zh|chi|zho|cn|chinese|中文"}.items():
        code = F.when(code.rlike(rf"^({names})([-_].*)?$"), F.lit(short)).otherwise(code)
    return code


def text_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, language, chars, lines and the STATISTICS of each document.

    The language is that of the text itself, the declared one only where the text doesn't tell. Lines that
    show nothing don't count. Null and blank texts have zeros throughout; long texts are counted whole;
    repeated rows give repeated rows; an empty table gives none.
    """
    schema = f"key {documents.schema[key].dataType.simpleString()}, language string, chars long, lines long, " + ", ".join(f"{s} double" for s in STATISTICS)
    rows = documents.select(F.struct(F.col(key).alias("key"), (_declared(F.col(lang)) if lang in documents.columns else F.lit(None).cast("string")).alias("declared")).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    nested = f"key struct<key:{documents.schema[key].dataType.simpleString()},declared:string>" + schema[schema.index(",") :]
    patterns = dict(PATTERNS)
    rows = rows.mapInArrow(lambda batches: _counted(batches, patterns), nested)
    return rows.select("key.key", F.coalesce("language", "key.declared", F.lit("und")).alias("language"), "chars", "lines", *STATISTICS)


def with_tails(statistics: DataFrame) -> DataFrame:
    """``statistics`` with percentile and robust z-score of each one within its language, and ``tails``, the flagged ones.

    z is measured from the median in units of the spread on the side of the prose, so that a heavy tail
    doesn't widen its own scale. A stray_share over STRAY is flagged at any z: where most of a language is no
    prose, its median isn't prose either. Languages without words of their own here are held, as those that
    can't be told, against all documents. Documents without characters get null scores and no flags.
    """
    statistics = cut(statistics, "statistics")
    told = statistics.where("chars > 0")
    known = F.col("language").isin("en", "de", "zh")
    sketches = told.groupBy(F.when(known, F.col("language")).otherwise("und").alias("pool")).agg(*(F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS))
    # Documents of a language that can't be told are held against all others: the sketches merged.
    pooled = sketches.groupBy(F.lit("und").alias("all")).agg(*(F.kll_merge_agg_double(s).alias(s) for s in STATISTICS)).withColumnRenamed("all", "pool")
    sketches = sketches.where("pool <> 'und'").unionByName(pooled)
    # A row per language: each statistic's quantiles at 0, 0.01 ... 1.
    grid = F.array(*(F.lit(i / 100) for i in range(101)))
    grids = sketches.select("pool", *(F.kll_sketch_get_quantile_double(s, grid).alias(f"{s}_grid") for s in STATISTICS))
    out, flags = statistics.withColumn("pool", F.when(known, F.col("language")).otherwise("und")).join(grids, "pool", "left").drop("pool"), []
    for s, (side, least) in STATISTICS.items():
        at = lambda q, s=s: F.col(f"{s}_grid")[q]
        upper, lower = (at(90) - at(50)) / 1.2816, (at(50) - at(10)) / 1.2816
        scale = {1: lower, -1: upper, 0: F.least(upper, lower)}[side]
        z = (F.col(s) - at(50)) / F.greatest(scale, F.lit(least))
        below = F.expr(f"size(filter({s}_grid, q -> q <= {s})) / 101")
        out = out.withColumn(f"{s}_pct", F.when(F.col("chars") > 0, below)).withColumn(f"{s}_z", F.when(F.col("chars") > 0, z))
        far = (F.col(f"{s}_z") if side == 1 else -F.col(f"{s}_z") if side == -1 else F.abs(f"{s}_z")) > TAIL
        flags.append(F.when(far | (F.col(s) > STRAY) if s == "stray_share" else far, F.lit(s)))
    return out.withColumn("tails", F.array_compact(F.array(*flags))).drop(*(f"{s}_grid" for s in STATISTICS))


def not_prose(statistics: DataFrame, share: float = 0.5) -> DataFrame:
    """key of documents flagged in a tail of which more than ``share`` of the characters stand outside sentences."""
    return with_tails(statistics).where((F.size("tails") > 0) & (F.col("stray_share") > share)).select("key")
