"""Commands: index, search, update, rename. Each returns its exit code; search as grep does: 0 something found, 1 nothing, 2 an error."""

from __future__ import annotations

import argparse
import re
import subprocess
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex import config as conf
from treedex.functions.text import selected_types
from treedex.operators import rename, search, stale
from treedex.operators.search import valid_patterns
from treedex.plans import index as plan, render
from treedex.plans.lineage import cut
from treedex.plans.store import ViewStore
from treedex.sources import files as source
from treedex.timing import Timed


def session() -> SparkSession:
    return SparkSession.builder.appName("treedex").getOrCreate()


def run_search(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    """search CONFIG PATTERN [-i] [-w] [-v] [-F] [-l] [-c] [-A n] [-B n] [-C n]: lines of the indexed files that match, as `path:line:text`.

    The files are those the index covers: its types, its excludes, no generated ones. Mind maps are searched as they are written.
    """
    p = argparse.ArgumentParser(prog="search", exit_on_error=False)
    p.add_argument("config")
    p.add_argument("pattern")
    for short, name in (("-i", "--ignore-case"), ("-w", "--word-regexp"), ("-v", "--invert-match"), ("-F", "--fixed-strings"), ("-l", "--files-with-matches"), ("-c", "--count"), ("-n", "--line-number"), ("-H", "--with-filename")):
        p.add_argument(short, name, action="store_true")
    for short, name in (("-A", "--after-context"), ("-B", "--before-context"), ("-C", "--context")):
        p.add_argument(short, name, type=int, default=0)
    try:
        a = p.parse_args(args)
        c = conf.load(a.config)
    except (argparse.ArgumentError, SystemExit, conf.ConfigError, OSError, ValueError) as e:
        print(f"error: {e}", file=err)
        return 2
    pattern = r"\Q" + a.pattern.replace(r"\E", r"\E\\E\Q") + r"\E" if a.fixed_strings else a.pattern
    if not a.fixed_strings and not valid_patterns(spark, [pattern])[pattern]:
        print(f"error: not a pattern: {a.pattern}", file=err)
        return 2
    kinds = selected_types(c.include_types, c.exclude_types)
    files = cut(source.discover(spark, c.include, c.exclude, kinds, c.output).filter(F.col("ftype").isin(kinds)).select(F.col("file_path").alias("path"), "content"))
    if files.isEmpty():
        print("no file to search: see directories and types of the configuration", file=err)
        return 1
    hits = cut(search.grep(files, pattern, a.ignore_case, a.word_regexp, a.invert_match))
    if hits.isEmpty():
        return 1
    if a.files_with_matches:
        rows = search.grep_files(hits).orderBy("path").select(F.col("path").alias("x"))
    elif a.count:
        rows = search.grep_counts(hits).orderBy("path").select(F.concat("path", F.lit(":"), "n").alias("x"))
    else:
        before, after = max(a.before_context, a.context), max(a.after_context, a.context)
        shown = search.grep_context(files, hits, before, after=after).join(hits.select("path", "line_no", F.lit(True).alias("hit")), ["path", "line_no"], "left") if before or after else hits.withColumn("hit", F.lit(True))
        mark = F.when(F.col("hit"), ":").otherwise("-")
        rows = shown.orderBy("path", "line_no").select(F.concat("path", mark, "line_no", mark, "line").alias("x"))
    for r in rows.toLocalIterator():
        print(r.x, file=out)
    return 0


def managed(spark: SparkSession, include: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What stale.scan() asks for: all files, contents of sources, manifests, their cards, areas. Hidden folders are no managed folders."""
    every = cut(source.listed(spark, include, every=True))
    special = source.read(every.filter("ftype in ('area', 'manifest')"))
    special = cut(special)
    heads, cards = (cut(x) for x in source.manifests_of(special))
    hidden = F.col("dir").rlike(r"/\.[^/]")
    wanted = cards.filter("source is not null and coalesce(source_hash, '') <> ''").select(F.col("source").alias("file_path")).distinct()
    return every, source.read_bytes(wanted), heads.filter(~hidden), cards, source.areas_of(special)


def run_update(spark: SparkSession, include: list[str], command: list[str] | None = None, out=sys.stdout) -> tuple[int, int]:
    """Say which managed folders are stale, and run a command in each, one after another; stale and current folders."""
    with Timed("staleness scan"):
        dirs = cut(stale.scan(*managed(spark, include)))

    def refresh(folder: str) -> None:
        print(f"stale: {folder}", file=out)
        if command and (code := subprocess.run(command, cwd=folder, check=False).returncode):
            print(f"warning: {command[0]} returned {code} for {folder}", file=out)

    bad, good = stale.update(dirs, refresh)
    print(f"{bad + good} managed folder(s), {bad} stale, {good} current", file=out)
    return bad, good


def run_index(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    """index CONFIG [--format freeplane|markdown] [--output PATH] [--words] [--update COMMAND...]: write the index a configuration asks for."""
    p = argparse.ArgumentParser(prog="index", exit_on_error=False)
    p.add_argument("config")
    p.add_argument("--format", choices=("freeplane", "markdown"))
    p.add_argument("--output")
    p.add_argument("--words", action="store_true")
    p.add_argument("--update", nargs=argparse.REMAINDER)
    try:
        a = p.parse_args(args)
        c = conf.load(a.config)
        c.format, c.output = a.format or c.format, a.output or c.output
        if a.words:
            c.views["word"] = "on"
        if a.update is not None:
            run_update(spark, c.include, a.update or None, out)
        index = plan.KnowledgeIndex.from_config(spark, c)
    except (argparse.ArgumentError, SystemExit, conf.ConfigError, OSError, ValueError) as e:
        print(f"error: {e}", file=err)
        return 2
    for w in index.keyword_rows.warnings:
        print(f"warning: {w}", file=err)
    with Timed("rendering", format=c.format):
        made = render.to_markdown(index, c.output) if c.format == "markdown" else [render.to_mindmap(index, c.output) or c.output]
    index.counts.log()
    print("\n".join(made), file=out)
    return 0


def run_refresh(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    """update CONFIG STORE [--compact]: bring the views kept at STORE up to date with the folders a configuration names; see plans.store."""
    p = argparse.ArgumentParser(prog="update", exit_on_error=False)
    p.add_argument("config")
    p.add_argument("store")
    p.add_argument("--compact", action="store_true")
    try:
        a = p.parse_args(args)
        c = conf.load(a.config)
        kept = ViewStore(spark, a.store)
        with Timed("update"):
            changed, gone = kept.sync(c.include, c.exclude, selected_types(c.include_types, c.exclude_types), c.output)
        if a.compact:
            kept.compact()
            kept.drop_old()
    except (argparse.ArgumentError, SystemExit, conf.ConfigError, OSError, ValueError) as e:
        print(f"error: {e}", file=err)
        return 2
    print(f"{changed} file(s) new or changed, {gone} gone", file=out)
    return 0


def run_rename(spark: SparkSession, args: list[str], out=sys.stdout, err=sys.stderr) -> int:
    """rename PATH OLD NEW [-r] [-n]: a domain's new name in cards and areas; 1 if no file is in reach."""
    p = argparse.ArgumentParser(prog="rename", exit_on_error=False)
    for x in ("path", "old", "new"):
        p.add_argument(x)
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-n", "--dry-run", action="store_true")
    try:
        a = p.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as e:
        print(f"error: {e}", file=err)
        return 2
    r = rename.rename_domain(spark, a.path, a.old, a.new, a.recursive, a.dry_run)
    for w in r.warnings:
        print(f"warning: {w}", file=err)
    for f in r.changed:
        print(("would update: " if a.dry_run else "updated: ") + f, file=out)
    return 0 if r.changed or r.skipped else 1


COMMANDS = {"search": run_search, "index": run_index, "update": run_refresh, "rename": run_rename}


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in COMMANDS:
        print(f"usage: {re.sub('[^a-z|]', '', '|'.join(COMMANDS))} ...", file=sys.stderr)
        return 2
    return COMMANDS[argv[0]](session(), argv[1:])


if __name__ == "__main__":
    sys.exit(main())
