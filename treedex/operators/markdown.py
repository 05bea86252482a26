"""Markdown as nodes, with windows instead of a parser's stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from treedex.functions.text import node_id
from treedex.operators.tree import nested

#: A heading's line (without white space around it) and a list item's. White space is Unicode's and the four separators \x1c to \x1f, digits are Unicode's, a line ends
#: at \n, \r or both alone.
HEADING, LIST_ITEM = r"^(#{1,6})\s+(.+)$", r"^(\s*)([-*+]|\d+\.)\s+(.+)$"
LINE_END, WHITE = r"\r\n?|\n", r"[\s\x1c-\x1f]"
#: Levels in a tree: headings 1 to 6; list items 7 plus half their indentation.
LISTS = 7


def _java(pattern: str) -> str:
    """The pattern with white space, digits and line ends as above."""
    return "(?dU)" + pattern.replace(r"\s", WHITE)


def stripped(line: str | Column) -> Column:
    return F.regexp_replace(line, rf"(?dU)^{WHITE}+|{WHITE}+\z", "")


def lines(files: DataFrame) -> DataFrame:
    """file_path, line_number, raw, kind (heading, list_item, content), level, text; blank lines left out. Text that isn't UTF-8 gives no line.

    Headings and content have no white space around them; a list item's text keeps what stands at its end.
    """
    head, item = _java(HEADING), _java(LIST_ITEM)
    line = files.select("file_path", F.posexplode(F.split("content", LINE_END)).alias("i", "raw")).withColumn("_s", stripped("raw")).filter("_s <> ''")
    kind = F.when(F.col("_s").rlike(head), "heading").when(F.col("raw").rlike(item), "list_item").otherwise("content")
    by_kind = lambda h, l, c: F.when(F.col("kind") == "heading", h).when(F.col("kind") == "list_item", l).otherwise(c)  # noqa: E731, E741
    level = by_kind(F.length(F.regexp_extract("_s", head, 1)), F.floor(F.length(F.regexp_extract("raw", item, 1)) / 2), F.lit(0))
    text = by_kind(F.regexp_extract("_s", head, 2), F.regexp_extract("raw", item, 3), F.col("_s"))
    return line.withColumn("kind", kind).select("file_path", (F.col("i") + 1).cast("bigint").alias("line_number"), "raw", "kind", level.cast("int").alias("level"), text.alias("text"))


def _numbered(lines_: DataFrame) -> DataFrame:
    """With section: the number of the heading that a line stands at or below, from 1; 0 above the first."""
    w = Window.partitionBy("file_path").orderBy("line_number")
    return lines_.withColumn("section", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(w))


def _body() -> Column:
    """Aggregate of a section: its heading's text and that of its content lines."""
    said = F.collect_list(F.when(F.col("kind") != "list_item", F.struct("line_number", "text")))
    return F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), " ")


def sections(lines_: DataFrame) -> DataFrame:
    """file_path, section (number of the heading, from 1), line_number of the heading, heading, content: its text and that of the content lines up to any next heading."""
    s = _numbered(lines_).filter("section > 0 and kind <> 'list_item'")
    return s.groupBy("file_path", "section").agg(F.min("line_number").alias("line_number"), F.min_by("text", "line_number").alias("heading"), _body().alias("content"))


def nodes(files: DataFrame, order: str = "source") -> DataFrame:
    """file_path, pre, last, parent_pre, node_type, level, text, content, search_text, line_number, node_id.

    order: `source` hangs list items under the heading they stand below; `compat` puts all headings first, so that they hang under the last one. The text is
    parsed once: a section's lines meet in one row, which gives its heading with its content, and its list items.
    """
    node = F.struct("line_number", "kind", "level", "text")
    met = _numbered(lines(files)).groupBy("file_path", "section").agg(_body().alias("body"), F.collect_list(F.when(F.col("kind") != "content", node)).alias("nodes"))
    n = met.select("file_path", "body", F.explode("nodes").alias("n")).select("file_path", "body", "n.*")
    n = n.withColumn("tree_level", F.when(F.col("kind") == "heading", F.col("level")).otherwise(LISTS + F.col("level")))
    by = ["line_number"] if order == "source" else [F.when(F.col("kind") == "heading", 0).otherwise(1), "line_number"]
    content = F.when(F.col("kind") == "heading", F.col("body")).otherwise(F.col("text"))
    n = n.withColumn("content", content).drop("body").withColumn("pre", F.row_number().over(Window.partitionBy("file_path").orderBy(*by)).cast("bigint"))
    n = nested(n, level="tree_level")
    return n.select("file_path", "pre", "last", "parent_pre", F.col("kind").alias("node_type"), "level", "text", "content", F.col("content").alias("search_text"), "line_number", node_id(F.lit(""), F.col("file_path"), F.col("pre")).alias("node_id"))
