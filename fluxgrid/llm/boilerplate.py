"""Lines repeated across the pages of one source (problem 3).

Lines become nodes (source, form), consecutive lines of a page edges; a node or an edge weighs as many pages
as show it. Nodes of high support stay, edges of high support between them join them, and the connected
components are the boilerplate blocks of the source, whose occurrences are deleted from the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm.visual_form import with_visual_form
from fluxgrid.operators.graphs import connected_components
from fluxgrid.sources.scratch import cut

#: Share of a source's pages, and number of pages, from which a line or a pair of lines is repeated excessively.
SHARE, PAGES = 0.08, 4


def line_form(looks: str) -> Column:
    """A visual form without case, amount of spacing and the digits of a run; null where nothing shows."""
    text = F.regexp_replace(F.lower(looks), "ß", "ss")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"\p{Nd}+", "0"))
    return F.when(text != "", text)


def formed_lines(lines: DataFrame) -> DataFrame:
    """line_id, source, page, line_no, form and node, which stands for the line's source and form."""
    rows = lines.where("source_id IS NOT NULL AND page_id IS NOT NULL").select("line_id", "source_id", "page_id", "line_no", "text")
    rows = with_visual_form(rows, "text", "looks").withColumn("form", line_form("looks"))
    node = F.when(F.col("form").isNotNull(), F.struct(F.xxhash64("source_id", "form").alias("a"), F.xxhash64("form", "source_id").alias("b")))
    return rows.select("line_id", F.col("source_id").alias("source"), F.col("page_id").alias("page"), "line_no", "form", node.alias("node"))


def _often(counted: DataFrame, sizes: DataFrame, weight: str) -> DataFrame:
    """Rows of counts by source of which ``weight`` is high for the source's number of pages."""
    return counted.where(F.col(weight) >= PAGES).join(sizes, "source").where(F.col(weight) >= SHARE * F.col("of")).drop("of")


def line_graph(lines: DataFrame, named: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, nodes, edges): lines of high support, and the graph of their forms.

    found: line_id, page, source, line_no, node; nodes: source, node, form, pages, block; edges: source, a, b,
    pages, block. ``block`` is the connected component; forms are null unless asked for by ``named``. A source may hold any share of the rows: its lines are
    counted by form first, and only forms seen on enough rows are counted by page. A source has few of these,
    at most its lines per page over SHARE, so that hot forms meet a small table.
    """
    lines = formed_lines(lines)
    lines = cut(lines if named else lines.drop("form"), "lines")
    sizes = lines.select("source", "page").distinct().groupBy("source").agg(F.count("*").alias("of"))
    counted = lines.where("node IS NOT NULL").groupBy("source", "node").agg(F.count("*").alias("rows"))
    often = _often(counted, sizes, "rows").select("node")
    nodes = lines.join(often, "node", "left_semi").select("source", "node", "page").distinct().groupBy("source", "node").agg(F.count("*").alias("pages"))
    nodes = cut(_often(nodes, sizes, "pages"), "nodes")
    found = cut(lines.join(nodes.select("node"), "node", "left_semi").distinct(), "found")
    here = found.where("line_no IS NOT NULL").select("source", "page", "line_no", F.col("node").alias("a"))
    below = found.where("line_no IS NOT NULL").select("source", "page", (F.col("line_no") - 1).alias("line_no"), F.col("node").alias("b"))
    pairs = here.join(below, ["source", "page", "line_no"]).select("source", "a", "b", "page").distinct()
    edges = cut(_often(pairs.groupBy("source", "a", "b").agg(F.count("*").alias("pages")), sizes, "pages"), "edges")
    blocks = connected_components(nodes, edges).withColumnRenamed("component", "block")
    forms = found.groupBy("node").agg(F.min("form") if named else F.max(F.lit(None).cast("string"))).toDF("node", "form")
    nodes = cut(nodes.join(blocks, "node").join(forms, "node").select("source", "node", "form", "pages", "block"), "graph")
    edges = edges.join(nodes.select(F.col("node").alias("a"), "block"), "a").select("source", "a", "b", "pages", "block")
    return found.select("line_id", "page", "source", "line_no", "node"), nodes, edges


def boilerplate_lines(lines: DataFrame) -> DataFrame:
    """line_id, page, source, node and block of each line that stands in a boilerplate block.

    Lines with a null source or page, null text or nothing that shows are never boilerplate; repeated rows
    count once; lines without line_no take part as nodes only.
    """
    found, nodes, _ = line_graph(lines)
    return found.join(nodes.select("node", "block"), "node").select("line_id", "page", "source", "node", "block")


def boilerplate_blocks(lines: DataFrame) -> DataFrame:
    """source, block, forms, edges, pages, weight, lines: the blocks of consecutive lines that return in a source.

    ``block`` is its smallest form, ``pages`` the support of its most frequent form, ``weight`` the sum of the
    support of its edges, ``lines`` the number of its occurrences, all of which ``without_boilerplate`` deletes.
    """
    found, nodes, edges = line_graph(lines, named=True)
    sizes = nodes.groupBy("source", "block").agg(F.min("form").alias("name"), F.count("*").alias("forms"), F.max("pages").alias("pages"))
    weights = edges.groupBy("source", "block").agg(F.count("*").alias("edges"), F.sum("pages").alias("weight"))
    seen = found.join(nodes.select("node", "block"), "node").groupBy("block").agg(F.countDistinct("line_id").alias("lines"))
    out = sizes.join(weights, ["source", "block"], "left").join(seen, "block")
    return out.select("source", F.col("name").alias("block"), "forms", F.coalesce("edges", F.lit(0)).alias("edges"), "pages", F.coalesce("weight", F.lit(0)).alias("weight"), "lines")


def without_boilerplate(lines: DataFrame) -> DataFrame:
    """page_id, source_id, lines, removed, text: each page without its boilerplate lines.

    Lines are in order of line_no, then line_id; repeated rows count once, null texts are left out. A page
    of nothing but boilerplate keeps its row with the empty text.
    """
    found = boilerplate_lines(lines).select("line_id").distinct().withColumn("gone", F.lit(True))
    rows = lines.where("source_id IS NOT NULL AND page_id IS NOT NULL").select("page_id", "source_id", "line_no", "line_id", "text").distinct()
    rows = rows.join(found, "line_id", "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("gone").isNull() & F.col("text").isNotNull(), F.struct("line_no", "line_id", "text"))))
    pages = rows.groupBy("page_id", "source_id").agg(kept.alias("kept"), F.count("gone").alias("removed"))
    return pages.select("page_id", "source_id", F.size("kept").alias("lines"), "removed", F.array_join("kept.text", "\n").alias("text"))
