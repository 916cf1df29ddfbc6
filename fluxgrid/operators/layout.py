"""Lines of pages as typed blocks, sections and readable paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgrid.functions import text as tx

MERGEABLE = ["paragraph", "table"]

#: Pages of a source that are looked at together when sections run on over pages.
RANGE = 1_000


def typed_lines(lines: DataFrame) -> DataFrame:
    """Layout lines that show something, once each, with block_type.

    A page's typical font is the median of its lines between header and footer, of all its lines if there are
    none; null fonts don't count.
    """
    lines = lines.dropDuplicates(["line_id"]).where("trim(text) <> ''")
    page = Window.partitionBy("page_id")
    inner = F.when((F.col("y1") > 0.08) & (F.col("y0") < 0.92), F.col("font_size"))
    lines = lines.withColumn("typical", F.coalesce(F.median(inner).over(page), F.median("font_size").over(page), F.lit(0.0)))
    kind = tx.block_type(F.col("text"), *(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.coalesce("font_size", F.lit(0.0)), F.col("typical"))
    return lines.withColumn("block_type", kind)


def block_runs(typed: DataFrame, gap: float = 0.035) -> DataFrame:
    """Adjacent lines of one mergeable type with a small vertical gap as one block.

    page_id, source_id, block_no, block_type, lines, y0, y1, text; block_no counts from 0 in reading order. The
    lines of a paragraph are joined to running text, those of a table stay lines.
    """
    order = Window.partitionBy("page_id").orderBy("line_no", "line_id")
    near = (F.col("block_type") == F.lag("block_type").over(order)) & F.col("block_type").isin(MERGEABLE) & (F.col("y0") - F.lag("y1").over(order) <= gap)
    runs = typed.withColumn("new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("block_no", F.sum("new").over(order) - 1)
    item = F.sort_array(F.collect_list(F.struct("line_no", "line_id", "text")))
    blocks = runs.groupBy("page_id", "source_id", "block_no").agg(F.min("block_type").alias("block_type"), F.count("*").alias("lines"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), item["text"].alias("parts"))
    text = F.when(F.col("block_type") == "paragraph", joined_paragraph("parts")).otherwise(F.array_join("parts", "\n"))
    return blocks.select("page_id", "source_id", "block_no", "block_type", "lines", "y0", "y1", text.alias("text"))


def joined_paragraph(parts: str) -> Column:
    """SQL of the parts of a paragraph joined: cut words put together, no blank after punctuation."""
    return F.expr(
        f"""aggregate({parts}, '', (s, t) -> CASE
            WHEN s = '' THEN t
            WHEN s LIKE '%-' AND t RLIKE '^[a-zäöüß]' THEN concat(left(s, length(s) - 1), t)
            WHEN s RLIKE '[，。；：！？、,.!?;:]$' OR t RLIKE '^[)）,.]' THEN concat(s, t)
            ELSE concat(s, ' ', t) END)"""
    )


def _carried(pages: DataFrame, columns: list[str], counts: list[str]) -> DataFrame:
    """``pages`` (source_id, page_id, page) with the last value of ``columns`` and the sum of ``counts`` of all pages before, as before_<name>.

    Ranges of pages are summed up first, so no source is sorted in one task.
    """
    order = Window.partitionBy("source_id", "range").orderBy("page", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.partitionBy("source_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("range", F.floor(F.coalesce("page", F.lit(0)) / RANGE))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("page", "page_id"))).alias(c) for c in columns]
    tops = pages.groupBy("source_id", "range").agg(*last, *(F.sum(c).alias(c) for c in counts))
    tops = tops.select("source_id", "range", *(F.last(c, ignorenulls=True).over(ranges).alias(f"far_{c}") for c in columns), *(F.sum(c).over(ranges).alias(f"far_{c}") for c in counts))
    out = pages.join(tops, ["source_id", "range"])
    before = [F.coalesce(F.last(c, ignorenulls=True).over(order), F.col(f"far_{c}")).alias(f"before_{c}") for c in columns]
    before += [(F.coalesce(F.sum(c).over(order), F.lit(0)) + F.coalesce(f"far_{c}", F.lit(0))).alias(f"before_{c}") for c in counts]
    return out.select("source_id", "page_id", *before)


def numbered_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (source_id, page_id and more) with pos, their place in the source from 0, and pages, how many it has.

    In order of ranges of page numbers, then of page_id; ranges are counted first, so no source is sorted at once.
    """
    pages = pages.withColumn("range", F.floor(F.coalesce(F.regexp_extract("page_id", r"(\d+)$", 1).try_cast("long"), F.lit(0)) / RANGE))
    sizes = pages.groupBy("source_id", "range").agg(F.count("*").alias("n"))
    source = Window.partitionBy("source_id")
    base = F.coalesce(F.sum("n").over(source.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("source_id", "range", base.alias("base"), F.sum("n").over(source).alias("pages"))
    nth = F.row_number().over(Window.partitionBy("source_id", "range").orderBy("page_id")) - 1
    return pages.withColumn("nth", nth).join(sizes, ["source_id", "range"]).withColumn("pos", (F.col("base") + F.col("nth")).cast("long")).drop("range", "nth", "base")


def section_paths(typed: DataFrame, sources: DataFrame) -> DataFrame:
    """line_id, page_id, source_id, line_no, title_run, section_no, section_path of every body line.

    A heading of level L ends all sections of level L and deeper, and goes on over the pages of its source; the
    path starts with the source's title, which a heading of level 1 takes the place of. Unnumbered headings
    in a row on a page are one title, joined by slashes. section_no counts the titles of the source so far.
    """
    body = typed.where(~F.col("block_type").isin("header", "footer", "page_number"))
    decided = body.withColumn("h", F.when(F.col("block_type") == "heading", tx.heading(F.col("text"))))
    decided = decided.withColumn("level", F.when(F.col("h.accepted"), F.col("h.level"))).withColumn("loose", F.coalesce(F.col("h.reason") == "unnumbered_heading", F.lit(False)))
    order = Window.partitionBy("page_id").orderBy("line_no", "line_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    decided = decided.withColumn("begins", F.col("level").isNotNull() & ~(F.col("loose") & F.coalesce(F.lag("loose").over(order), F.lit(False))))
    decided = decided.withColumn("run", F.sum(F.when(F.col("begins") | F.col("level").isNull(), 1).otherwise(0)).over(upto))
    names = F.sort_array(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("line_no", "line_id", tx.single_line(F.col("text")).alias("t")))).over(Window.partitionBy("page_id", "run")))
    out = decided.withColumn("mark", F.when(F.col("level").isNotNull(), F.struct("level", F.array_join(names["t"], " / ").alias("title"))))
    out = out.withColumn("own_no", F.count_if("begins").over(upto))
    levels = range(1, 7)
    for level in levels:
        out = out.withColumn(f"l{level}", F.last(F.when(F.col("level") <= level, F.col("mark")), ignorenulls=True).over(upto))
    place = F.struct("line_no", "line_id")
    pages = out.groupBy("source_id", "page_id").agg(*(F.max_by(f"l{n}", F.when(F.col(f"l{n}").isNotNull(), place)).alias(f"l{n}") for n in levels), F.count_if("begins").alias("titles"))
    pages = pages.withColumn("page", F.regexp_extract("page_id", r"(\d+)$", 1).try_cast("long"))
    out = out.join(_carried(pages, [f"l{n}" for n in levels], ["titles"]), ["source_id", "page_id"])
    for level in levels:
        out = out.withColumn(f"l{level}", F.coalesce(f"l{level}", f"before_l{level}"))
    # The last heading of level <= n stands for level n only if it is of that level itself.
    titles = [F.when(F.col(f"l{n}.level") == n, F.col(f"l{n}.title")) for n in levels]
    named = sources.select("source_id", F.col("title").alias("source_title")).dropDuplicates(["source_id"])
    out = out.join(named, "source_id", "left")
    path = F.array_compact(F.array(F.coalesce(titles[0], F.col("source_title")), *titles[1:]))
    return out.select("line_id", "page_id", "source_id", "line_no", F.when(F.col("level").isNotNull(), F.col("run")).alias("title_run"), (F.col("own_no") + F.col("before_titles")).alias("section_no"), F.array_join(path, " > ").alias("section_path"))


def article_units(lines: DataFrame, headings: DataFrame, furniture: list[str]) -> DataFrame:
    """Articles read in the order of their lines: page_id, source_id, section_no, unit_no, kind, lines, text.

    ``headings`` (source_id, marker, occurrence, following): a page's line that is the marker for the
    occurrence-th time there begins a section, and takes up to ``following`` more lines of its page, unless
    one of them begins a section itself. All else between two headings of a page is one unit of text. Lines that match one
    of ``furniture`` as a whole, and lines that show nothing, are left out; every other line is in one unit. section_no
    counts the headings of the source so far, over pages.
    """
    rows = lines.select("line_id", "page_id", "source_id", "line_no", tx.single_line(F.col("text")).alias("t")).distinct()
    rows = rows.where(F.col("t") != "").where(~F.col("t").rlike("^(?:" + "|".join(furniture) + ")$"))
    order = Window.partitionBy("source_id", "page_id").orderBy("line_no", "line_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    nth = F.row_number().over(Window.partitionBy("source_id", "page_id", "t").orderBy("line_no", "line_id"))
    marks = headings.groupBy("source_id", F.col("marker").alias("t"), F.col("occurrence").alias("nth")).agg(F.max("following").alias("following"))
    rows = rows.withColumn("nth", nth).join(marks, ["source_id", "t", "nth"], "left").withColumn("at", F.row_number().over(order))
    last = F.last(F.when(F.col("following").isNotNull(), F.struct("at", "following")), ignorenulls=True).over(upto)
    rows = rows.withColumn("h", last).withColumn("title", F.coalesce(F.col("at") - F.col("h.at") <= F.col("h.following"), F.lit(False)))
    begins = F.col("following").isNotNull() | (F.col("at") == 1) | (~F.col("title") & F.lag("title").over(order))
    rows = rows.withColumn("begins", begins).withColumn("unit_no", F.count_if("begins").over(upto)).withColumn("own", F.count_if(F.col("following").isNotNull()).over(upto))
    item = F.sort_array(F.collect_list(F.struct("line_no", "line_id", "t")))
    units = rows.groupBy("source_id", "page_id", "unit_no").agg(F.when(F.bool_or("title"), "title").otherwise("text").alias("kind"), F.count("*").alias("lines"), F.max("own").alias("own"), item["t"].alias("parts"))
    pages = units.groupBy("source_id", "page_id").agg(F.max("own").alias("titles")).withColumn("page", F.regexp_extract("page_id", r"(\d+)$", 1).try_cast("long"))
    units = units.join(_carried(pages, [], ["titles"]), ["source_id", "page_id"])
    return units.select("page_id", "source_id", (F.col("own") + F.col("before_titles")).alias("section_no"), "unit_no", "kind", "lines", F.array_join("parts", "\n").alias("text"))


def page_text(lines: DataFrame) -> DataFrame:
    """page_id, source_id, text of the lines in order, lines, native_chars and ocr_chars."""
    lines = lines.select("line_id", "page_id", "source_id", "line_no", "text", "source").distinct()
    items = F.sort_array(F.collect_list(F.struct("line_no", "line_id", F.coalesce("text", F.lit("")).alias("text"))))
    chars = lambda kind: F.sum(F.when(F.col("source") == kind, F.length(F.col("text"))).otherwise(0))
    pages = lines.groupBy("page_id", "source_id").agg(items.alias("items"), F.count("*").alias("lines"), chars("native").alias("native_chars"), chars("ocr").alias("ocr_chars"))
    return pages.select("page_id", "source_id", F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("text"), "lines", "native_chars", "ocr_chars")


# The least height and the share of it within which lines share a row, and the gap that parts cells.
ROW_HEIGHT, ROW_SHARE, CELL_GAP = 0.008, 0.55, 0.04


def same_row_merge(lines: DataFrame) -> DataFrame:
    """Lines of a page whose centre lies near the running mean centre of the row before, as rows.

    page_id, row_no, pieces, text, x0, y0, x1, y1, confidence. The mean changes with every line that joins,
    so a page's lines are folded in order of (y0, x0); pieces wider apart than 0.04 are set off by a bar.
    """
    item = F.struct("y0", "x0", "line_no", "y1", "x1", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    pages = lines.where("y0 IS NOT NULL AND y1 IS NOT NULL").dropDuplicates(["page_id", "line_no"]).groupBy("page_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    pages = pages.selectExpr(
        "page_id",
        f"""aggregate(items, named_struct('rows', cast(array() AS array<array<struct<y0:double,x0:double,line_no:int,y1:double,x1:double,text:string,confidence:double>>>), 'sum', 0D, 'n', 0),
            (s, i) -> CASE WHEN s.n > 0 AND abs((i.y0 + i.y1) / 2 - s.sum / s.n) <= greatest(i.y1 - i.y0, {ROW_HEIGHT}D) * {ROW_SHARE}D
                THEN named_struct('rows', concat(slice(s.rows, 1, size(s.rows) - 1), array(array_append(s.rows[size(s.rows) - 1], i))), 'sum', s.sum + (i.y0 + i.y1) / 2, 'n', s.n + 1)
                ELSE named_struct('rows', array_append(s.rows, array(i)), 'sum', (i.y0 + i.y1) / 2, 'n', 1) END,
            s -> s.rows) AS rows""",
    )
    rows = pages.select("page_id", F.posexplode("rows").alias("row_no", "row"))
    rows = rows.withColumn("row", F.expr("array_sort(row, (a, b) -> CASE WHEN a.x0 < b.x0 THEN -1 WHEN a.x0 > b.x0 THEN 1 ELSE a.line_no - b.line_no END)"))
    joined = f"""aggregate(row, named_struct('t', '', 'x', cast(NULL AS double)), (s, i) -> named_struct('t', concat(s.t, CASE WHEN s.x IS NULL THEN '' WHEN i.x0 - s.x > {CELL_GAP} THEN ' | ' WHEN s.t RLIKE '[ /-]$' THEN '' ELSE ' ' END, i.text), 'x', i.x1), s -> s.t)"""
    return rows.select(
        "page_id", "row_no", F.size("row").alias("pieces"), tx.normalize(F.expr(joined)).alias("text"),
        F.array_min("row.x0").alias("x0"), F.array_min("row.y0").alias("y0"), F.array_max("row.x1").alias("x1"), F.array_max("row.y1").alias("y1"),
        F.expr("aggregate(row.confidence, 0D, (a, b) -> a + b) / size(row)").alias("confidence"),
    )
