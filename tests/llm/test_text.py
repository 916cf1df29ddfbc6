"""Visual forms, conversations, boilerplate, scanned pages and quality statistics on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from fluxgrid.llm import boilerplate, conversations, quality, scanned, visual_form


def forms(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, form string")
    return [r.form for r in visual_form.with_visual_form(rows, "t", "form").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＡＢ１２，", "AB12,"), ("Grün", "Grün"), ("a b", "a b"), ("a　b", "a b"), ("pa​ste﻿", "paste"), ("Сорреr", "Copper"), ("ﬁne", "fine"), ("⼒", "力"), ("Ω", "Ω"), ("µ", "μ"), ("non‐stop", "non-stop"), ("ӧl", "öl"), ("a\r\nb", "a\nb"), ("ｶﾞ", "ガ"), ("不", "不")],
)
def test_same_look(spark, a, b):
    assert len(set(forms(spark, [a, b]))) == 1


@pytest.mark.parametrize(("a", "b"), [("m²", "m2"), ("é", "e"), ("A", "a"), ("a  b", "a b"), ("a\nb", "a b"), ("1", "l"), ("a.", "a"), ("a-b", "a–b"), ("ß", "ss"), ("Ω", "O")])
def test_other_look(spark, a, b):
    assert len(set(forms(spark, [a, b]))) == 2


def test_form_of_odd_texts(spark):
    long = "Ａ" * 300_000
    assert forms(spark, [None, "", "x" * 300_000, long]) == [None, "", "x" * 300_000, "A" * 300_000]
    assert forms(spark, []) == []


def test_pairs(spark):
    rows = [("a", "x y"), ("b", "x y"), ("c", "x y"), ("d", "x y"), ("d", "x y"), ("e", "other"), ("f", None), (None, "x y"), ("g", "")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("k", F.lit(1)).withColumn("f", F.lit(2))
    got = {tuple(r) for r in visual_form.look_alike_pairs(df, "id", "text").collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "d"), ("c", "d")}
    assert visual_form.look_alike_pairs(df.limit(0), "id", "text").count() == 0


MESSAGES = "row_id long, message_id string, conversation_id string, role string, content string, created_at string"


def chat(spark, rows, known=("A", "B", "C")):
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("at", F.lit("clash")).withColumn("fragment", F.lit(0))
    return messages, spark.createDataFrame([(k,) for k in known], "conversation_id string")


def rebuilt(spark, rows, known=("A", "B", "C")):
    got = conversations.rebuild_conversations(*chat(spark, rows, known)).collect()
    return {(r.conversation_id, r.turn, r.message_id) for r in got}


def test_conversation_order_and_copies(spark):
    rows = [
        (3, "m3", "a", "bot", "answer", "2025-01-01T10:00:02Z"), (1, "m1", " A ", "System", "rules", "2025-01-01 10:00:00"), (2, "m2", "A", "human", "question", "1735725601000"),
        (9, " M2", "a", "human", "question", "2025-01-01T10:00:01Z"), (2, "m2", "A", "human", "question", "1735725601000"),
        (5, "x1", None, "user", "lost", "2025-01-01T10:00:00Z"),
    ]
    assert rebuilt(spark, rows) == {("A", 1, "m1"), ("A", 2, "m2"), ("A", 3, "m3")}


@pytest.mark.parametrize(
    "broken",
    [
        (2, "m2", "b", "assistant", "​ 　", "2025-01-01T10:00:01Z"), (2, "m2", "b", "assistant", None, "2025-01-01T10:00:01Z"), (2, "m2", "b", "???", "x", "2025-01-01T10:00:01Z"), (2, "m2", "b", None, "x", "2025-01-01T10:00:01Z"),
        (2, "m2", "b", "assistant", "x", "2025-02-30T10:00:00Z"), (2, "m2", "b", "assistant", "x", None), (2, "m2", "b", "user", "x", "2025-01-01T10:00:01Z"), (2, "m2", "b", "assistant", "x", "2024-01-01T10:00:01Z"), (2, "m2", "b", "system", "x", "2025-01-01T10:00:01Z"),
    ],
)
def test_broken_conversations(spark, broken):
    assert rebuilt(spark, [(1, "m1", "b", "user", "x", "2025-01-01T10:00:00Z"), broken]) == set()


def test_conversations_unknown_or_empty(spark):
    rows = [(1, "m1", "z", "user", "x", "2025-01-01T10:00:00Z"), (2, "m2", "z", "assistant", "x", "2025-01-01T10:00:00Z")]
    assert rebuilt(spark, rows) == set()
    assert rebuilt(spark, [], known=("A",)) == set()


@pytest.mark.parametrize(("size", "overlap"), [(2, 1), (4, 2), (9, 4), (10, 7), (256, 8)])
def test_long_conversations_over_fragments(spark, size, overlap):
    rows = [(i, None if i % 7 == 0 else f"m{i}", "C", "user" if i % 2 == 0 else "assistant", f"t{i}", "2025-01-01T10:00:00Z") for i in range(100)]
    random.Random(1).shuffle(rows)
    export = lambda r: conversations.export_fragments(r, size, overlap)
    got = conversations.rebuild_conversations(*chat(spark, rows), export, overlap).collect()
    assert sorted((r.turn, r.message_id) for r in got if r.message_id) == [(i + 1, f"m{i}") for i in range(100) if i % 7]
    assert len(got) == 100


@pytest.mark.parametrize("lost", range(5))
def test_a_lost_fragment_drops_its_conversation(spark, lost):
    rows = [(c * 100 + i, f"m{c}{i}", "AB"[c], "user" if i % 2 == 0 else "assistant", "t", f"2025-01-01T10:00:{i:02d}Z") for c in range(2) for i in range(12)]

    def export(r):
        made = conversations.export_fragments(r)
        assert made.where("conversation = 'a'").count() == 5 and made.selectExpr("max(size(items))").first()[0] == 4
        return made.where(f"NOT (conversation = 'a' AND fragment = {lost})")

    assert {r.conversation_id for r in conversations.rebuild_conversations(*chat(spark, rows)).collect()} == {"A", "B"}
    got = conversations.rebuild_conversations(*chat(spark, rows), export).collect()
    assert {r.conversation_id for r in got} == {"B"} and len(got) == 12


def test_assembly_of_ambiguous_or_circular_fragments(spark):
    rows = [("fork", 0, [1, 2]), ("fork", 1, [2, 3]), ("fork", 2, [2, 4]), ("circle", 0, [1, 2]), ("circle", 1, [2, 3]), ("circle", 2, [3, 1]), ("one", 0, [7])]
    frame = spark.createDataFrame([(c, i, [(h,) for h in hs]) for c, i, hs in rows], "conversation string, fragment int, items array<struct<h:long>>")
    assert [tuple(r) for r in conversations.assemble_fragments(frame, 1).collect()] == [("one", 0, 0, 0)]


def test_assembly_of_given_fragments(spark):
    hashes = [random.Random(2).getrandbits(60) + i for i in range(60)]
    rng, rows = random.Random(3), []
    for name, at in (("whole", list(range(0, 50, 10))), ("gap", [0, 10, 30, 40])):
        rows += [(name, i, hashes[a : a + 10 + rng.randint(1, 3)]) for i, a in enumerate(at)]
    frame = spark.createDataFrame([(c, i, [(h,) for h in hs]) for c, i, hs in rows], "conversation string, fragment int, items array<struct<h:long>>")
    got = {(r.conversation, r.fragment): (r.start, r.skip) for r in conversations.assemble_fragments(frame, 3).collect()}
    assert {k for k, _ in got} == {"whole"}
    for i in range(5):
        start, skip = got["whole", i]
        assert start + skip == i * 10 + skip and start == i * 10


LINES = "line_id long, page_id string, source_id string, line_no int, text string"


def test_boilerplate(spark):
    rows = []
    for p in range(20):
        for n, text in enumerate([f"Body of page {p} " + "abcdefghij"[p % 10] * (p + 1), "PAGE 7 of  9" if p % 2 else "Раge 12 of 30", "© 2020 Rights"]):
            rows.append((p * 3 + n, f"s:p{p}", "s", n, text))
    rows += [rows[1], (900, None, "s", 1, "Page 1 of 1"), (901, "s:p0", None, 1, "Page 1 of 1"), (902, "s:p1", "s", None, "page 3 of 3"), (903, "s:p2", "s", 9, None), (904, "s:p3", "s", 9, "  ")]
    df = spark.createDataFrame(rows, LINES).withColumn("node", F.lit("clash"))
    found = boilerplate.boilerplate_lines(df).collect()
    assert {r.line_id for r in found} == {i for i in range(60) if i % 3} | {902}
    assert len({r.block for r in found}) == 1
    pages = {r.page_id: r.text for r in boilerplate.without_boilerplate(df).collect()}
    assert len(pages) == 20 and all("Rights" not in t and t.startswith("Body") for t in pages.values())
    assert boilerplate.boilerplate_lines(df.limit(0)).count() == 0


def test_boilerplate_needs_pages_not_rows(spark):
    rows = [(i, f"s:p{i % 3}", "s", i, "same line") for i in range(30)]
    assert boilerplate.boilerplate_lines(spark.createDataFrame(rows, LINES)).count() == 0


OCR = "page_id string, line_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def pages_of(lines, start=1):
    """One page per list: a header, body lines at an even pitch, a page number."""
    rows = []
    for p, body in enumerate(lines, start):
        rows.append((f"s:p{p:04d}", 1, "Running Title", 0.1, 0.03, 0.5, 0.05, 0.9))
        rows += [(f"s:p{p:04d}", n, t, 0.1, 0.1 + 0.05 * (n - 2), 0.8, 0.12 + 0.05 * (n - 2), 0.9) for n, t in enumerate(body, 2)]
        rows.append((f"s:p{p:04d}", len(body) + 2, str(p), 0.1, 0.95, 0.12, 0.97, None))
    return rows


def test_faults_of_scanned_pages(spark):
    rng = random.Random(4)
    words = "stencil solder placement reflow nozzle capacitor inspection temperature profile cleaning tombstone component".split()
    text = [[" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(10)] for _ in range(30)]
    confused = 0
    for p in range(0, 30, 3):  # s is read as 5, e as c
        text[p][1] = text[p][1].replace("s", "5", 1)
        text[p + 1][2] = text[p + 1][2].replace("e", "c", 1)
        confused += 2
    text[0][4], text[0][5] = "the sol-", "der held and both pre-"
    text[0][6] = "and post-reflow images."
    text[3][9], text[4][0] = "a tempe-", "rature reached"
    rows = pages_of(text)
    df = spark.createDataFrame([*rows, rows[2], (None, 1, "x", 0.1, 0.1, 0.2, 0.2, 0.5), ("s:p0001", None, "x", 0.1, 0.1, 0.2, 0.2, 0.5)], OCR).withColumn("w", F.lit("clash"))
    got = {}
    for r in scanned.faults(df).collect():
        got.setdefault(r.kind, set()).add((r.page_id, r.line_no))
    assert got["running"] == {(f"s:p{p:04d}", n) for p in range(1, 31) for n in (1, 12)}
    assert got["hyphen"] == {("s:p0001", 6), ("s:p0004", 11)}
    assert len(got["misread"]) == confused
    pages = {}
    for r in scanned.paragraphs(df).collect():
        pages[r.page_id] = pages.get(r.page_id, "") + r.text
    assert "the solder held and both pre- and post-reflow images." in pages["s:p0001"]
    assert pages["s:p0004"].endswith("a temperature") and pages["s:p0005"].startswith("reached")
    assert not any("5" in t for t in pages.values())


def test_misread_words_on_copies_of_a_page(spark):
    rng = random.Random(4)
    words = "stencil solder placement reflow nozzle capacitor inspection temperature profile cleaning tombstone component".split()
    text = [[" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(10)] for _ in range(30)]
    for p in range(0, 30, 3):
        text[p][1] = text[p][1].replace("s", "5", 1)
    for p in (2, 4, 5, 7, 8, 10):
        text[p][4] = f"number {p} of the words is zigsag here."
    text[1][5] = "one zig5ag was here."
    copies = [text[1]] * 12
    got = scanned.faults(spark.createDataFrame(pages_of(text + copies), OCR)).where("kind = 'misread'").collect()
    assert {(r.page_id, r.line_no) for r in got} >= {(f"s:p{p:04d}", 7) for p in (2, *range(31, 43))}


def test_paragraphs_go_on_over_pages(spark):
    end = "and here the text of the page ends."
    bodies = [["the first page has", "a sentence that"], ["runs over a whole", "page until it"], ["stops here.", ">Another one stands", end], ["no longer the same.", "this one is open"], [">an indented line.", end], ["last and"], ["Title of Another", ">opens with this."]]
    rows = [(*r[:2], r[2].lstrip(">"), r[3] + 0.03 * r[2].startswith(">"), *r[4:]) for r in pages_of(bodies)]
    # The same number in other series, and a page that is missing, go on with nothing.
    rows += [(f"t{r[0][1:]}", *r[1:]) for r in pages_of([["alone and"]], 8) + pages_of([["after a gap"]], 10)]
    rows = [r for r in rows if 0.1 <= r[4] < 0.95]  # pages as short as these have no pitch that sets edge lines apart
    got = {(r.page_id, r.paragraph): r.text for r in scanned.flowing_paragraphs(spark.createDataFrame(rows, OCR)).collect()}
    assert got == {
        ("s:p0001", 0): "the first page has a sentence that runs over a whole page until it stops here.", ("s:p0003", 1): "Another one stands " + end, ("s:p0004", 0): "no longer the same. this one is open",
        ("s:p0005", 1): "an indented line. " + end, ("s:p0006", 0): "last and", ("s:p0007", 0): "Title of Another", ("s:p0007", 1): "opens with this.", ("t:p0008", 0): "alone and", ("t:p0010", 0): "after a gap",
    }


def test_scanned_pages_of_nothing(spark):
    empty = spark.createDataFrame([], OCR)
    assert scanned.faults(empty).count() == 0 and scanned.paragraphs(empty).count() == 0
    odd = spark.createDataFrame([("a", 1, None, None, None, None, None, None), ("b", 1, "", 0.1, 0.1, 0.2, 0.2, 1.0), ("c", 1, "x" * 100_000, 0.1, 0.1, 0.2, 0.2, 1.0)], OCR)
    assert scanned.faults(odd).count() == 0


PROSE = "The paste was stored for nine hours and it must be at room temperature before the jar is opened. "


def stats(spark, texts, lang="en"):
    rows = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("words", F.lit("clash"))
    return {r.key: r for r in quality.text_statistics(rows).collect()}


def test_statistics(spark):
    got = stats(spark, [PROSE.strip(), None, " \n ", "| a | b |\n| 1 | 2 |", "锡膏必须回温到室温后才能开封，不得混用。", "x" * 500_000])
    assert got[0].words == 19 and got[0].end_share == 1.0 and got[0].stray_share == 0.0 and got[0].language == "en"
    assert got[0].mean_word_length == pytest.approx(len(PROSE.replace(" ", "").replace(".", "")) / 19)
    assert (got[1].chars, got[2].chars, got[2].words) == (0, 0, 0.0)
    assert got[3].stray_share == 1.0 and got[4].language == "zh" and got[4].stray_share == 0.0 and got[5].chars == 500_000


@pytest.mark.parametrize(
    "junk",
    ["- soak time\n- peak temperature\n- chip resistor, 9 N\n- belt speed", "| 12 | OK | n/a |\n| 13 | OK | 9 N |", "QFN-1558;12;OK\nRES-2205;n/a;7", "pA0+/xGq77Jd/ppz0QqLmWw\nZk9/2vbbR+Qa0LmNnR7==", "2025-01-01T00:00:00 [WARN] code=1 dt=2ms\n2025-01-01T00:00:09 [WARN] code=4 dt=3ms", "paste paste paste paste paste paste", "Home | Login | News\nBack > Support"],
)
def test_not_prose(spark, junk):
    texts = [PROSE * n for n in range(1, 30)] + [PROSE.lower().replace(". ", "\n"), PROSE + "\n- soak time", junk, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.key for r in quality.not_prose(quality.text_statistics(rows)).collect()] == [31]


def test_not_prose_where_most_of_a_language_is_junk(spark):
    junk = [f"- soak time\n- peak temperature {i}\n- chip resistor of size\n- belt speed" for i in range(20)]
    texts = [(i, t, "en") for i, t in enumerate([PROSE * 2] * 5 + junk)] + [(100 + i, "| 12 | OK |\n| 13 | 9 |", "fr") for i in range(3)]
    rows = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert sorted(r.key for r in quality.not_prose(quality.text_statistics(rows)).collect()) == [*range(5, 25), 100, 101, 102]


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.not_prose(quality.text_statistics(empty)).count() == 0
