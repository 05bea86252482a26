"""Mind maps (`map` > `node`*): a recursive format, so an Arrow-batched parser emits the interval encoding directly."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex.functions.text import node_id

#: Entities that XML doesn't know and such files hold.
ENTITIES = {"nbsp": 160, "copy": 169, "reg": 174, "trade": 8482, "hellip": 8230, "mdash": 8212, "ndash": 8211, "lsquo": 8216, "rsquo": 8217, "ldquo": 8220, "rdquo": 8221, "bull": 8226}
SCHEMA = "file_path string, pre bigint, last bigint, parent_pre bigint, level int, xml_id string, text string, richcontent string, note string, tags array<string>, created string, modified string"


def _tree(content: str):
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        try:
            root = ET.fromstring(re.sub(r"&(\w+);", lambda m: f"&#{ENTITIES[m[1]]};" if m[1] in ENTITIES else m[0], content))
        except ET.ParseError:
            return None
    return root if root.tag == "map" else None


def _body(node, kind: str, below: bool = False) -> str:
    """The text of a node's own rich text of a kind; with below, of the first anywhere below it, in order of the file."""
    own = node.iter("richcontent") if below else node.findall("richcontent")
    found = next((r for r in own if r.get("TYPE") == kind), None)
    body = found.find("html/body") if found is not None else None
    return " ".join(t for t in (x.strip() for x in body.itertext()) if t) if body is not None else ""


def parse(path: str, content: str | None, below: bool = False) -> list[tuple]:
    """Rows of SCHEMA; none for what isn't a mind map. Maps of any depth. below: a node without rich text has that of the first node below it."""
    root = _tree(content or "")
    top = root.find(".//node") if root is not None else None
    rows: list[list] = []
    stack = [(iter([top]), None, 1)] if top is not None else []
    while stack:
        children, parent, level = stack[-1]
        node = next(children, None)
        if node is None:
            stack.pop()
            if parent is not None:
                rows[parent - 1][2] = len(rows)
            continue
        pre = len(rows) + 1
        rows.append([path, pre, pre, parent, level, node.get("ID") or "", html.unescape(node.get("TEXT") or ""), _body(node, "NODE", below), _body(node, "NOTE", below), html.unescape(node.get("TAGS") or "").split(), node.get("CREATED"), node.get("MODIFIED")])
        stack.append((iter(node.findall("node")), pre, level + 1))
    return [tuple(r) for r in rows]


def nodes(files: DataFrame, below: bool = False) -> DataFrame:
    """files: file_path, content. Nodes with search_text (text, content, rich text and note) and tags; below: see parse()."""

    def run(batches):
        for rows in batches:
            out = [r for p, c in zip(rows["file_path"], rows["content"], strict=True) for r in parse(p, c, below)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")]).astype({"parent_pre": "Int64"})

    n = files.select("file_path", "content").mapInPandas(run, SCHEMA)
    full = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("text", "richcontent", "note")))
    again = F.concat_ws(" ", F.nullif("text", F.lit("")), F.nullif(full, F.lit("")), F.nullif("richcontent", F.lit("")), F.nullif("note", F.lit("")))
    return n.withColumns({"content": full, "search_text": again, "node_type": F.lit("node"), "node_id": node_id(F.col("xml_id"), F.col("file_path"), F.col("pre"))})


class NodesOf:
    """A table function: a map's rows of parse() without its path; none for null and for what isn't a map."""

    def eval(self, content: str, below: bool = False):
        for row in parse("", content, bool(below)):
            yield row[1:]


def register(spark: SparkSession, name: str = "mindmap_nodes") -> None:
    """Let SQL call it: `SELECT f.file_path, n.* FROM files f, LATERAL mindmap_nodes(f.content) n`; a second argument is `below` of parse().

    Files go to workers in Arrow batches, where they lie; a LEFT JOIN LATERAL .. ON TRUE keeps files without nodes.
    """
    spark.udtf.register(name, F.udtf(NodesOf, returnType=SCHEMA.split(", ", 1)[1], useArrow=True))
