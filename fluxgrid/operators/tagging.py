"""Rule-based tags of texts, with a trace of every match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxgrid.functions.text import holds_term

# Terms of the domain by the tag that they give; kind, tag, terms.
RULES = [
    ("process", "printing", ["stencil printing", "solder paste printing", "schablonendruck", "锡膏印刷"]),
    ("process", "placement", ["component placement", "pick-and-place", "bestückung", "元件贴装"]),
    ("process", "reflow", ["reflow soldering", "reflowlöten", "回流焊接"]),
    ("defect", "insufficient_solder", ["insufficient solder", "lotmangel", "焊料不足"]),
    ("defect", "excess_solder", ["excess solder", "solder balling", "lotperlen", "焊料过多", "锡珠"]),
    ("defect", "short", ["short circuit", "bridging", "shorting", "kurzschlüsse", "lötbrücken", "短路", "桥连"]),
    ("defect", "shifted_component", ["component shift", "skewed placement", "bauteilversatz", "元件偏移"]),
]

# The order in which tags are listed.
ORDER = ["printing", "placement", "reflow", "insufficient_solder", "excess_solder", "short", "shifted_component"]

# Titles of sections that are never tagged.
EXCLUDED = ["contents", "references", "index", "目录", "inhalt"]

# Relations by the cause through which they are known; relation, cause, process, defect.
RELATIONS = [
    ("relation-01", "cause-aperture", "printing", "insufficient_solder"),
    ("relation-02", "cause-squeegee", "printing", "excess_solder"),
    ("relation-03", "cause-nozzle", "placement", "shifted_component"),
    ("relation-04", "cause-void", "reflow", "insufficient_solder"),
]

# How strongly each relation is established, and the order of strengths; any other comes last.
STRENGTHS = {"relation-01": "strong", "relation-02": "conditional", "relation-03": "medium_strong", "relation-04": "medium_strong"}
STRENGTH_ORDER = ["strong", "medium_strong", "conditional"]

# Terms of causes.
CAUSES = {
    "cause-aperture": ["aperture", "apertures", "schablonenöffnung", "开孔"],
    "cause-squeegee": ["squeegee", "squeegee pressure", "rakel", "刮刀"],
    "cause-nozzle": ["nozzle", "vacuum nozzle", "saugdüse", "吸嘴"],
    "cause-void": ["voids", "lunker", "空洞"],
}

# Rules for sections of one source; rule, source, words in the section's title, process, role.
SECTIONS = [
    ("section-01", "placement_bulletin_en_2020", "process audit", "placement", "process_guideline"),
    ("section-02", "cleaning_notes_de_2019", "prüfbericht", None, "troubleshooting_guidance"),
    ("section-03", "inspection_guide_en_2012", "field report", None, "defect_mechanism"),
]

# Terms that mean too little by themselves to be a rule.
DISABLED = ["bridging", "shorting"]


def listed_rules() -> list[tuple[str, str, str]]:
    """(kind, tag, term), longest terms first; a term is listed once, the first rule wins."""
    first = {}
    for kind, tag, terms in RULES:
        for term in terms:
            first.setdefault(term, (kind, tag, term))
    return sorted(first.values(), key=lambda r: (-len(r[2]), r))


def rules(spark: SparkSession) -> DataFrame:
    """kind, tag, term of ``listed_rules``."""
    return spark.createDataFrame(listed_rules(), "kind string, tag string, term string")


def matches(texts: DataFrame) -> DataFrame:
    """key, kind, tag, term, matched_in of texts (key, title, text): a rule is looked for in the title, else in the text.

    The rules are a short fixed list and go into the plan, each with a pattern of its own, so each text is read once
    and nothing is joined. Texts under an excluded title have no matches.
    """
    low = texts.select("key", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    low = low.where(~F.trim("title").isin(EXCLUDED))
    found = []
    for kind, tag, term in listed_rules():
        where = F.when(holds_term(F.col("title"), term), "title").when(holds_term(F.col("text"), term), "text")
        found.append(F.when(where.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), F.lit(term).alias("term"), where.alias("matched_in"))))
    return low.select("key", F.explode(F.array_compact(F.array(*found))).alias("m")).select("key", "m.*")


def tags(found: DataFrame) -> DataFrame:
    """key, tags in canonical order as one string, n_matches, origin (title, text or both)."""
    sets = found.groupBy("key").agg(F.collect_set("tag").alias("have"), F.count("*").alias("n_matches"), F.bool_or(F.col("matched_in") == "title").alias("t"), F.bool_or(F.col("matched_in") == "text").alias("b"))
    listed = F.filter(F.array(*(F.lit(t) for t in ORDER)), lambda t: F.array_contains(F.col("have"), t))
    return sets.select("key", F.array_join(listed, ",").alias("tags"), "n_matches", F.when(F.col("t") & F.col("b"), "mixed").when(F.col("t"), "title").otherwise("text").alias("origin"))


def tag_counts(found: DataFrame) -> DataFrame:
    """kind, tag, texts for every tag of the rules, 0 where none has it."""
    every = rules(found.sparkSession).select("kind", "tag").distinct()
    counted = found.groupBy("tag").agg(F.countDistinct("key").alias("texts"))
    return every.join(counted, "tag", "left").select("kind", "tag", F.coalesce("texts", F.lit(0)).alias("texts"))


def traced_rules() -> list[tuple[str, str, str | None, str | None, str]]:
    """(rule, category, process, defect, term) of all terms that aren't disabled; a cause gives what its relation links."""
    rules = [(f"{kind}:{tag}", kind, tag if kind == "process" else None, tag if kind == "defect" else None, term) for kind, tag, term in listed_rules()]
    for relation, cause, process, defect in RELATIONS:
        rules += [(f"{cause}:{relation}", "cause", process, defect, term) for term in CAUSES[cause]]
    return [r for r in rules if r[-1] not in DISABLED]


def trace(texts: DataFrame, sources: DataFrame) -> DataFrame:
    """key, rule, category, process, defect, role, term, matched_in: everything that speaks for a text, once each.

    ``texts`` (key, source, title, text) are searched for terms as in ``matches``, their titles for the words
    of their source's section rules; ``sources`` (source, roles) give roles by default. Texts under an excluded
    title have nothing. Null titles, texts and sources match nothing.
    """
    texts = texts.select("key", "source", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    texts = texts.where(~F.trim("title").isin(EXCLUDED))
    given = lambda value, name: F.lit(value).cast("string").alias(name)
    match = lambda rule, category, process, defect, role, term, where: F.struct(given(rule, "rule"), given(category, "category"), given(process, "process"), given(defect, "defect"), given(role, "role"), given(term, "term"), where.alias("matched_in"))
    found = []
    for rule, category, process, defect, term in traced_rules():
        where = F.when(holds_term(F.col("title"), term), "title").when(holds_term(F.col("text"), term), "text")
        found.append(F.when(where.isNotNull(), match(rule, category, process, defect, None, term, where)))
    for rule, source, words, process, role in SECTIONS:
        found.append(F.when((F.col("source") == source) & holds_term(F.col("title"), words), match(rule, "section", process, None, role, words, F.lit("section"))))
    terms = texts.select("key", F.explode(F.array_compact(F.array(*found))).alias("m")).select("key", "m.*")
    roles = sources.select("source", F.explode("roles").alias("role")).distinct()
    none = F.lit(None).cast("string")
    default = texts.select("key", "source").join(roles, "source").select("key", F.concat(F.lit("default:"), "source").alias("rule"), F.lit("default").alias("category"), none.alias("process"), none.alias("defect"), "role", F.col("source").alias("term"), F.lit("source").alias("matched_in"))
    return terms.unionByName(default).distinct()


def mapped(texts: DataFrame, found: DataFrame) -> DataFrame:
    """key, excluded, processes, defects (in canonical order), roles (in order of the alphabet), n_matches of every text, '' where nothing speaks."""
    sets = found.groupBy("key").agg(F.count("*").alias("n"), *(F.collect_set(c).alias(c) for c in ("process", "defect", "role")))
    listed = lambda c: F.array_join(F.filter(F.array(*(F.lit(t) for t in ORDER)), lambda t: F.array_contains(c, t)), ",")
    excluded = F.trim(F.lower(F.coalesce("title", F.lit("")))).isin(EXCLUDED)
    out = texts.select("key", excluded.alias("excluded")).join(sets, "key", "left")
    shown = lambda c: F.coalesce(c, F.lit(""))
    return out.select("key", "excluded", shown(listed("process")).alias("processes"), shown(listed("defect")).alias("defects"), shown(F.array_join(F.sort_array("role"), ",")).alias("roles"), F.coalesce("n", F.lit(0)).alias("n_matches"))


def cause_candidates(found: DataFrame) -> DataFrame:
    """defect, rank, relation, cause, process, strength, texts: causes of each defect, strongest relations first.

    ``found`` is a trace; texts counts those that name the cause, 0 where none does. Equal strengths go by relation.
    """
    listed = found.sparkSession.createDataFrame([(defect, relation, cause, process, STRENGTHS.get(relation)) for relation, cause, process, defect in RELATIONS], "defect string, relation string, cause string, process string, strength string")
    counted = found.where("category = 'cause'").groupBy("rule").agg(F.countDistinct("key").alias("texts"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(s) for s in STRENGTH_ORDER)), F.col("strength")), F.lit(0)), F.lit(99))
    rows = listed.withColumn("rule", F.concat_ws(":", "cause", "relation")).join(counted, "rule", "left")
    rank = F.row_number().over(Window.partitionBy("defect").orderBy(place, "relation"))
    return rows.select("defect", rank.alias("rank"), "relation", "cause", "process", "strength", F.coalesce("texts", F.lit(0)).alias("texts"))
