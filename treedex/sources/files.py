"""File discovery and reading by tasks: the driver opens the first folders, tasks walk what lies below them (hidden folders too, which Spark's readers skip)."""

from __future__ import annotations

import fnmatch
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treedex.functions.text import FILE_TYPES, MARKER, MARKER_WINDOW, selected_types
from treedex.timing import Counts

SCHEMA = "file_path string, dir string, name string, ftype string, length bigint, mtime_ns bigint, root string"
#: Text that a worker holds at once, but for a single longer file.
BATCH_BYTES = 1 << 24
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def is_excluded(path: str, patterns: list[str]) -> bool:
    """As functions.text.excluded, for a single path while walking."""
    parts = set(path.split("/"))
    return any(bool(parts & {x for x in p.split("/") if x and "**" not in x}) if "**" in p else fnmatch.fnmatch(path, p) for p in patterns)


def type_of(name: str, known: dict[str, str] = FILE_TYPES) -> str | None:
    return next((known[e] for e in sorted(known, key=len, reverse=True) if name.lower().endswith(e)), None)


def roots(include: list[str]) -> tuple[list[str], list[str]]:
    """Folders to walk, and warnings: a file stands for its folder, a missing path is passed over."""
    found, warnings = [], []
    for p in include:
        p = os.path.abspath(os.path.expanduser(p))
        if os.path.isdir(p):
            found.append(p)
        elif os.path.isfile(p):
            found.append(os.path.dirname(p))
        else:
            warnings.append(f"not found: {p}")
    return list(dict.fromkeys(found)), warnings


#: Files of a card folder that aren't indexed but read: an area's settings and a folder's record of its cards.
BESIDE = {"kb.yml": "area", "segmentation.yml": "manifest"}


def kind_of(here: str, name: str, types: list[str] | None, known: dict[str, str] = FILE_TYPES) -> str | None:
    """A file's type if it is wanted: one of types, `area` or `manifest`; with types None every file, `other` if of no type."""
    if os.path.basename(here) == ".kb" and name in BESIDE:
        return BESIDE[name]
    kind = type_of(name, known)
    return (kind or "other") if types is None else kind if kind in types else None


def files_of(here: str, names: list[str], root: str, exclude: list[str], types: list[str] | None, output: str | None, known: dict[str, str] = FILE_TYPES):
    for name in sorted(names):
        path = os.path.join(here, name)
        kind = kind_of(here, name, types, known)
        if kind is None or is_excluded(path, exclude) or output and path == os.path.abspath(output):
            continue
        try:
            s = os.stat(path)
        except OSError:  # gone since, or a link to nothing
            continue
        yield path, here, name, kind, s.st_size, s.st_mtime_ns, root


def walk(include: list[str], exclude: list[str] | None = None, types: list[str] | None = None, output: str | None = None):
    """Rows of SCHEMA, folders pruned before they are entered; each file once. For a few folders; see listed()."""
    exclude, types, seen = exclude or [], types or selected_types(), set()
    for root in roots(include)[0]:
        for here, dirs, names in os.walk(root):
            dirs[:] = sorted(d for d in dirs if not is_excluded(os.path.join(here, d), exclude))
            for row in files_of(here, names, root, exclude, types, output):
                if row[0] not in seen and row[3] in types:
                    seen.add(row[0])
                    yield row


def below(here: str, exclude: list[str], wanted=None) -> list[str]:
    """Folders directly in a folder that aren't excluded and, if wanted(path) says so, wanted; none where it can't be read."""
    try:
        with os.scandir(here) as found:
            return sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and not is_excluded(e.path, exclude) and (wanted is None or wanted(e.path)))
    except OSError:
        return []


def work(include: list[str], exclude: list[str], few: int, wanted=None) -> list[tuple[str, str, bool]]:
    """Folders to list as (folder, root, with all below it): opened level by level until there are `few`, or none is left to open."""
    open_, closed = [(r, r) for r in roots(include)[0] if wanted is None or wanted(r)], []
    while open_ and len(open_) < few:
        closed, open_ = closed + open_, [(d, root) for here, root in open_ for d in below(here, exclude, wanted)]  # of those that were opened only the files are left to list
    return [(h, r, False) for h, r in closed] + [(h, r, True) for h, r in open_]


def listed(spark: SparkSession, include: list[str], exclude: list[str] | None = None, types: list[str] | None = None, output: str | None = None, every: bool = False) -> DataFrame:
    """SCHEMA of all wanted files, areas and manifests among them, each once (of the first root that has it); every: files of any type.

    The driver opens folders level by level until there are several for each core, or none; tasks walk below those, so no list of files is on the driver.
    """
    exclude, wanted = exclude or [], None if every else types or selected_types()
    known = dict(FILE_TYPES)  # as registered here: a worker only knows the built-in ones
    few = 4 * spark.sparkContext.defaultParallelism
    todo_ = work(include, exclude, few)

    def run(batches):
        for rows in batches:
            for here, root, deep in zip(rows["here"], rows["root"], rows["deep"], strict=True):
                held = []
                for now, dirs, names in os.walk(here):
                    dirs[:] = sorted(d for d in dirs if not is_excluded(os.path.join(now, d), exclude)) if deep else []
                    held += files_of(now, names, root, exclude, wanted, output, known)
                    if len(held) > 10_000:
                        yield pd.DataFrame(held, columns=COLUMNS)
                        held = []
                yield pd.DataFrame(held, columns=COLUMNS)

    if not todo_:
        return spark.createDataFrame([], SCHEMA)
    todo = spark.createDataFrame(todo_, "here string, root string, deep boolean").repartition(min(len(todo_), few))
    return todo.mapInPandas(run, SCHEMA).groupBy("file_path").agg(F.min(F.struct("root", *(c for c in COLUMNS if c not in ("file_path", "root")))).alias("r")).select("file_path", *(f"r.{c}" for c in COLUMNS if c != "file_path"))


def discover(spark: SparkSession, include: list[str], exclude: list[str] | None = None, types: list[str] | None = None, output: str | None = None, counts: Counts | None = None) -> DataFrame:
    """SCHEMA and content, text of files that are UTF-8 and not generated ones; areas and manifests among them, by ftype. counts: see usable()."""
    return usable(read(listed(spark, include, exclude, types, output)), counts)


def usable(files: DataFrame, counts: Counts | None = None) -> DataFrame:
    """Files with text that aren't generated ones. With counts, files are kept first and stage `read` has their rows and bytes, and how many are unreadable, blank or generated."""
    generated = F.contains(F.substring("content", 1, MARKER_WINDOW), F.lit(MARKER))
    if counts:
        files = counts.cut("read", files, bytes=F.sum("length"), unreadable=F.count_if(F.col("content").isNull()), blank=F.count_if(~F.col("content").rlike(r"\S")), generated=F.count_if(generated))
    return files.filter("content is not null").filter(~generated)


def text_of(path: str) -> str | None:
    """A file's text with line ends as \\n; None where it can't be read or isn't UTF-8."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return None


def read(listed: DataFrame) -> DataFrame:
    """Adds content; null where a file can't be read or isn't UTF-8. A batch holds BATCH_BYTES of text, or one file."""

    def contents(batches):
        for rows in batches:
            out, first, size = [], 0, 0
            for i, p in enumerate(rows["file_path"]):
                out.append(text_of(p))
                size += len(out[-1] or "")
                if size > BATCH_BYTES:
                    yield rows.iloc[first : i + 1].assign(content=out)
                    out, first, size = [], i + 1, 0
            if out:
                yield rows.iloc[first:].assign(content=out)

    return listed.repartition("file_path").mapInPandas(contents, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema.fields) + ", content string")


def read_bytes(paths: DataFrame) -> DataFrame:
    """paths: file_path. Adds content (binary; null where a file is gone or can't be read, which leaves no row for one that is gone) and is_dir."""

    def run(batches):
        for rows in batches:
            out = []
            for p in rows["file_path"]:
                if os.path.isdir(p):
                    out.append((p, None, True))
                elif os.path.exists(p):
                    try:
                        with open(p, "rb") as f:
                            out.append((p, f.read(), False))
                    except OSError:
                        out.append((p, None, False))
            yield pd.DataFrame(out, columns=["file_path", "content", "is_dir"])

    return paths.repartition("file_path").mapInPandas(run, "file_path string, content binary, is_dir boolean")


def above_kb(path: Column) -> Column:
    """The folder whose card folder holds a file."""
    return F.regexp_replace(path, r"/\.kb/[^/]*$", "")


def areas_of(files: DataFrame) -> DataFrame:
    """dir, domain, source_exclude of area files among files (ftype `area`), read by tasks."""

    def run(batches):
        for rows in batches:
            out = []
            for p, c in zip(rows["file_path"], rows["content"], strict=True):
                v = _mapping(c)
                out.append((os.path.dirname(os.path.dirname(p)), None if v.get("domain") is None else str(v["domain"]), [str(x) for x in v.get("source_exclude") or []]))
            yield pd.DataFrame(out, columns=["dir", "domain", "source_exclude"])

    return files.filter("ftype = 'area'").select("file_path", "content").mapInPandas(run, "dir string, domain string, source_exclude array<string>")


def parsed_manifests(files: DataFrame) -> DataFrame:
    """dir, fingerprint and cards (pos, kind, source, source_hash) of manifests among files, a row each, read by tasks; sources resolved against the card folder."""

    def run(batches):
        for rows in batches:
            out = []
            for p, c in zip(rows["file_path"], rows["content"], strict=True):
                v, kb = _mapping(c), os.path.dirname(p)
                out.append((os.path.dirname(kb), None if v.get("dir_fingerprint") is None else str(v["dir_fingerprint"]), [(i, x.get("kind"), local_path(x.get("source"), kb), x.get("source_hash")) for i, x in enumerate(v.get("cards") or []) if isinstance(x, dict)]))
            yield pd.DataFrame(out, columns=["dir", "fingerprint", "cards"])

    # parsing takes longer than so few bytes suggest, so it is dealt out, however few partitions the files have
    dealt = files.filter("ftype = 'manifest'").select("file_path", "content").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file_path")
    return dealt.mapInPandas(run, "dir string, fingerprint string, cards array<struct<pos:int,kind:string,source:string,source_hash:string>>")


def manifests_of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dir, fingerprint) and (dir, pos, kind, source, source_hash) of manifests among files. Each parses anew; parsed_manifests() has both in one row."""
    every = parsed_manifests(files)
    return every.select("dir", "fingerprint"), every.select("dir", F.explode("cards").alias("c")).select("dir", "c.*")


def local_path(source, kb: str) -> str | None:
    """The first local path of a source (a text, a link or a list of them), from the card folder; None for web addresses alone."""
    for x in source if isinstance(source, list) else [source]:
        m = re.fullmatch(r"\[[^\]]*\]\(<?([^>)]*)>?\)", str(x).strip()) if x else None
        path = m[1] if m else str(x or "").strip()
        if path and not path.startswith(("http://", "https://")):
            return os.path.normpath(os.path.join(kb, path))
    return None


#: What libyaml and PyYAML's own parser read differently (characters, tags, `?` and `:{` in flow collections), and nodes that may nest; libyaml has no bound on nesting.
UNLIKE, OPENING, MOST_OPEN = re.compile(r"[^\n\x20-\x7E\w]|[!?]|:[\[{]"), re.compile(r"[\[{]|-\s"), 3000


def _mapping(content: str | None) -> dict:
    """A YAML text's mapping, {} where it is none, as PyYAML's safe_load reads it; by libyaml, some 9 times faster, where both read the same."""
    import yaml

    fast = getattr(yaml, "CSafeLoader", None)
    if fast and content and not UNLIKE.search(content) and len(OPENING.findall(content)) <= MOST_OPEN:
        try:
            v = yaml.load(content, fast)  # noqa: S506: a safe loader
            return v if isinstance(v, dict) else {}
        except yaml.YAMLError:  # it may be stricter
            pass
    try:
        v = yaml.safe_load(content or "")
    except yaml.YAMLError:
        v = None
    return v if isinstance(v, dict) else {}
