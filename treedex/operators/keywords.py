"""The keyword language: a tab-indented tree whose leaves are searches."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from treedex.functions.text import anchor_slug, keyword_display
from treedex.operators.search import search_multiple, split_terms, valid_patterns
from treedex.operators.tree import nearest_heading

DEPTH_WARNED = 7
SCHEMA = "kw_file string, pre bigint, last bigint, parent_pre bigint, level int, text string, is_leaf boolean, line_number bigint, sequence array<string>, category string, scope_domains array<string>"


@dataclass
class Keywords:
    rows: list[tuple] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def indent_level(line: str) -> int:
    """A tab is one level, a blank a quarter; fractions are dropped."""
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return int(lead.count("\t") + lead.count(" ") * 0.25)


def parse(text: str, name: str = "", scope: list[str] | None = None) -> Keywords:
    """Rows of SCHEMA in order of lines; comments (#) and blank lines left out."""
    lines = [(i, indent_level(x), x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip() and not x.strip().startswith("#")]
    out, stack, lasts, open_ = Keywords(), [], [len(lines)] * len(lines), []
    for k, (_, level, _) in enumerate(lines):
        while open_ and lines[open_[-1]][1] >= level:
            lasts[open_.pop()] = k
        open_.append(k)
    for k, (number, level, body) in enumerate(lines, 1):
        while stack and stack[-1][1] >= level:
            stack.pop()
        last = lasts[k - 1]
        leaf = last == k
        category = stack[0][2] if stack else "Direct Searches" if leaf else body
        out.rows.append((name, k, last, stack[-1][0] if stack else None, level, body, leaf, number, split_terms(body) if leaf else None, category, scope))
        if ":" in body and not leaf:
            out.warnings.append(f"line {number}: ':' in a keyword that has others below it: {body}")
        if level + 1 == DEPTH_WARNED:
            out.warnings.append(f"line {number}: {DEPTH_WARNED} levels deep")
        stack.append((k, level, body))
    return out


def parsed(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA of many keyword files (kw_file, content), each parsed by the task that has it; a null content has none."""

    def run(batches):
        for rows in batches:
            out = [r for name, text in zip(rows["kw_file"], rows["content"], strict=True) if text is not None for r in parse(text, name).rows]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("kw_file", "content").mapInPandas(run, SCHEMA)


def entries(rows: DataFrame) -> DataFrame:
    """kw_file, pre, text, display_name, is_leaf, level, search_sequence (a leaf's, split at every colon) and above, the text of the entry above, null at the top."""
    up = rows.select(F.col("kw_file").alias("_f"), F.col("pre").alias("_p"), F.col("text").alias("above"))
    sequence = F.when(F.col("is_leaf"), F.transform(F.split("text", ":"), F.trim))
    return rows.join(up, (F.col("kw_file") == F.col("_f")) & (F.col("parent_pre") == F.col("_p")), "left").select("kw_file", "pre", "text", keyword_display(F.col("text")).alias("display_name"), "is_leaf", "level", sequence.alias("search_sequence"), "above")


def load(paths: list[str], scoped_paths: list[dict] = []) -> Keywords:  # noqa: B006
    """All files' rows; a file that can't be read is a warning. scoped_paths: path and domain, a name or a list of names, for keywords of those domains alone."""
    out = Keywords()
    own = [(p, None) for p in paths]
    for x in scoped_paths:
        d = x.get("domain")
        own.append((x.get("path", ""), None if d is None else [d] if isinstance(d, str) else list(d)))
    for p, scope in own:
        try:
            with open(p, encoding="utf-8") as f:
                one = parse(f.read(), p, scope)
            out.rows += one.rows
            out.warnings += one.warnings
        except (OSError, UnicodeDecodeError) as e:
            out.warnings.append(f"{p}: {e}")
    return out


def frame(spark: SparkSession, keywords: Keywords) -> DataFrame:
    return spark.createDataFrame(keywords.rows, SCHEMA)


def display(text: str) -> str:
    return text.replace(":", " → ")


def hierarchy(keywords: Keywords) -> dict:
    """Entries by text, as a file's author sees them: text, display_name, is_leaf, level, children, and a leaf's search_sequence, split at every colon."""
    top: dict = {}
    inside: dict[tuple[str, int], dict] = {}
    for r in keywords.rows:
        name, pre, _, parent, level, text, leaf = r[:7]
        entry = {"text": text, "display_name": display(text), "is_leaf": leaf, "level": level, "children": {}}
        if leaf:
            entry["search_sequence"] = [t.strip() for t in text.split(":")]
        (top if parent is None else inside[name, parent])[text] = entry
        inside[name, pre] = entry["children"]
    return top


def chains(spark: SparkSession, keywords: Keywords) -> DataFrame:
    """kw_file, pre, chain (text and a unique key of each entry from the top down to this one), text, is_leaf, sequence, scope_domains."""
    above: dict[tuple[str, int], list] = {}
    rows = []
    for r in keywords.rows:
        above[r[0], r[1]] = [*above.get((r[0], r[3]), []), (r[5], f"{r[0]}:{r[1]:09d}")]
        rows.append((r[0], r[1], above[r[0], r[1]], r[5], r[6], r[8], r[10]))
    return spark.createDataFrame(rows, "kw_file string, pre bigint, chain array<struct<text:string,key:string>>, text string, is_leaf boolean, sequence array<string>, scope_domains array<string>")


def scoped(keywords: DataFrame, domains: DataFrame) -> DataFrame:
    """Keywords for each domain: global ones for all, scoped ones for their domains, all for a null domain, only global ones for `none`."""
    scope = F.col("scope_domains")
    fits = scope.isNull() | F.col("domain").isNull() | ((F.col("domain") != "none") & F.array_contains(scope, F.col("domain")))
    return domains.join(keywords, fits)  # keyword files are written by hand; Spark broadcasts what is small


def search(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Every leaf with its hits; a leaf without any, or with a pattern that isn't valid, has one row of nulls."""
    leaves = keywords.filter("is_leaf").select("kw_file", "pre", "text", "sequence").collect()  # written by hand
    good = valid_patterns(keywords.sparkSession, sorted({t for r in leaves for t in r.sequence}))
    usable = [list(x) for x in sorted({tuple(r.sequence) for r in leaves if r.sequence and all(good[t] for t in r.sequence)})]
    kw = keywords.filter("is_leaf").select("kw_file", F.col("pre").alias("kw_pre"), F.col("text").alias("keyword"), F.array_join("sequence", ":").alias("sequence"))
    if not usable:
        return kw.select("*", F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("bigint").alias("pre"), F.lit(None).cast("string").alias("matched"))
    return kw.join(search_multiple(nodes, usable).select("sequence", "file_path", "pre", "matched"), "sequence", "left")


def by_heading(hits: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """hits: keys, file_path, pre, more. Each with its nearest heading's anchor and heading_text; of hits with equal keys below one heading of a file the first stays, hits below none all stay."""
    places = hits.select("file_path", "pre").distinct()
    near = nearest_heading(nodes, places).select(F.col("file_path").alias("_f"), F.col("pre").alias("_p"), anchor_slug(F.col("heading_text")).alias("anchor"), "heading_text")
    all_ = hits.join(near, (hits["file_path"] == near["_f"]) & (hits["pre"] == near["_p"]), "left").drop("_f", "_p")
    w = Window.partitionBy(*keys, "file_path", F.coalesce("anchor", F.concat(F.lit("#"), F.col("pre").cast("string")))).orderBy("pre")
    return all_.withColumn("_r", F.row_number().over(w)).filter((F.col("_r") == 1) | F.col("anchor").isNull()).drop("_r")
