"""Renaming a domain in cards and areas: which files are in reach, what would change, and writing it back."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex.functions.text import renamed_domain
from treedex.sources.files import read

COLUMNS = "file_path string, changed boolean, written boolean"


def in_reach(path: str, recursive: bool = False) -> tuple[list[str], list[str]]:
    """Cards and area files that a path stands for, and warnings: a card itself; a card folder's files, and with recursive those of all card folders beside
    and below it; a folder's card folder, and with recursive all below."""
    own = lambda kb: [os.path.join(kb, n) for n in sorted(os.listdir(kb)) if (n.endswith(".kb.md") or n == "kb.yml") and os.path.isfile(os.path.join(kb, n))]
    path = os.path.abspath(path)
    if os.path.isfile(path):
        return ([path], []) if path.endswith(".kb.md") else ([], [f"no card: {path}"])
    if not os.path.isdir(path):
        return [], [f"not found: {path}"]
    top, first = (os.path.dirname(path), [path]) if os.path.basename(path) == ".kb" else (path, [])
    if not recursive:
        kb = first or [os.path.join(path, ".kb")]
        return (own(kb[0]), []) if os.path.isdir(kb[0]) else ([], [f"no card folder directly below: {path}"])
    below = sorted(os.path.join(here, d) for here, dirs, _ in os.walk(top) for d in dirs if d == ".kb")
    return [f for kb in [*first, *(b for b in below if b not in first)] for f in own(kb)], []


def renamed(files: DataFrame, old: str, new: str) -> DataFrame:
    """files: file_path, content. Adds new_content and changed: a card's frontmatter alone, an area's whole text."""
    area = F.col("file_path").endswith("/kb.yml")
    to = F.when(area, renamed_domain(F.col("content"), old, new, whole=True)).otherwise(renamed_domain(F.col("content"), old, new))
    return files.withColumn("new_content", to).withColumn("changed", ~F.col("new_content").eqNullSafe(F.col("content")))


@dataclass
class Result:
    changed: list[str]
    skipped: int
    warnings: list[str]


def rename_domain(spark: SparkSession, path: str, old: str, new: str, recursive: bool = False, dry_run: bool = False) -> Result:
    """Write the new name into all files in reach; with dry_run only say which would change. Tasks write beside a file and move, so that a task run again does no harm."""
    paths, warnings = in_reach(path, recursive)
    if not paths:
        return Result([], 0, warnings)
    listed = spark.createDataFrame([(p,) for p in paths], "file_path string")
    changes = renamed(read(listed).filter("content is not null"), old, new)

    def write(batches):
        for rows in batches:
            for p, text, changed in zip(rows["file_path"], rows["new_content"], rows["changed"], strict=True):
                if changed and not dry_run:
                    temp = f"{p}.{uuid.uuid4().hex}.tmp"
                    with open(temp, "w", encoding="utf-8", newline="") as f:
                        f.write(text)
                    os.replace(temp, p)
            yield pd.DataFrame({"file_path": rows["file_path"], "changed": rows["changed"], "written": rows["changed"] & (not dry_run)})

    done = changes.select("file_path", "new_content", "changed").mapInPandas(write, COLUMNS).collect()  # names of cards in reach
    return Result(sorted(r.file_path for r in done if r.changed), sum(not r.changed for r in done), warnings)
