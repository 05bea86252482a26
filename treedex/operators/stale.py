"""Staleness: a folder's fingerprint first, then hashes of its sources, then new files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from treedex.functions.text import excluded, glob_column
from treedex.operators.domains import nearest_area


#: File names that are never a source: sync conflicts, converted maps, an assistant's instructions.
NO_SOURCE = ["*.conflict*", "*.mm.md", "CLAUDE.md"]
#: Characters of lines that a row of fingerprint()'s blocks holds, but for a single longer line.
BLOCK = 1 << 12


def _blocks(batches):
    """Sorted rows of dir, name, line: neighbours of one folder as one text of about BLOCK characters, n telling apart blocks that begin with equal rows."""
    n = 0
    for rows in batches:
        out, size = [], 0
        for here, name, line in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if not out or out[-1][0] != here or size >= BLOCK:
                out.append((here, name, line, n, []))
                n, size = n + 1, 0
            out[-1][4].append(line)
            size += len(line)
        if out:
            here, name, first, number, lines = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(here, rows.schema.field(0).type), pa.array(name, pa.string()), pa.array(first, pa.string()), pa.array(number, pa.int64()), pa.array(["".join(x) for x in lines], pa.string())], ["dir", "name", "first", "n", "text"])


def _fed(batches):
    """Blocks in order, a folder's one after another: its hash is carried from batch to batch, a row a folder comes out."""
    now, hashed, kind = None, None, pa.string()
    for rows in batches:
        kind, out = rows.schema.field(0).type, []
        for here, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if hashed is None or here != now:
                if hashed is not None:
                    out.append((now, "sha256:" + hashed.hexdigest()))
                now, hashed = here, hashlib.sha256()
            hashed.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], kind), pa.array([x for _, x in out], pa.string())], ["dir", "fingerprint"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array(["sha256:" + hashed.hexdigest()], pa.string())], ["dir", "fingerprint"])


def fingerprint(files: DataFrame, dir: str = "dir") -> DataFrame:
    """dir, fingerprint: `sha256:` and the hash of `name,size,time` and a line end for each file that isn't hidden, in order of names.

    files: all files of the folders, whatever their type. An empty folder has no row here; empty_fingerprint() is its value. A file without a size or a
    time has no line, one without a name is left out; rows that are there twice count twice.

    Lines are sorted by ranges of all folders' names and joined to blocks there; then each folder's blocks feed its hash in order. So a folder of any size
    is sorted in parts and is never one row; what one task does for it is to hash its bytes.
    """
    shown = files.filter(~F.col("name").startswith("."))
    line = F.concat("name", F.lit(","), F.col("length").cast("string"), F.lit(","), F.col("mtime_ns").cast("string"), F.lit("\n"))
    lines = shown.select(F.col(dir).alias("dir"), "name", F.coalesce(line, F.lit("")).alias("line"))
    kind = lines.schema["dir"].dataType.simpleString()
    blocks = lines.repartitionByRange("dir", "name", "line").sortWithinPartitions("dir", "name", "line").mapInArrow(_blocks, f"dir {kind}, name string, first string, n bigint, text string")
    fed = blocks.repartition("dir").sortWithinPartitions("dir", "name", "first", "n").select("dir", "text").mapInArrow(_fed, f"dir {kind}, fingerprint string")
    return fed.withColumnRenamed("dir", dir)


def empty_fingerprint() -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.lit("").cast("binary"), 256))


def changed(manifest_cards: DataFrame, files: DataFrame) -> DataFrame:
    """manifest_cards: dir, kind, source, source_hash, and pos (the entry's place) if there is one. Adds stale: the file is gone, can't be read, or its hash doesn't begin with the stored one.

    Folder summaries and entries without a hash or a local source are left out; of a source listed twice the first entry counts. files: file_path and
    content (null: can't be read) or is_dir true, which is never stale.
    """
    m = manifest_cards.filter("coalesce(kind, '') <> 'dir_summary' and coalesce(source_hash, '') <> '' and source is not null and not source rlike '^https?://'")
    m = m.groupBy("dir", "source").agg((F.min_by("source_hash", "pos") if "pos" in m.columns else F.min("source_hash")).alias("source_hash"))
    now = files.select(F.col("file_path").alias("source"), F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)).alias("hash"), (F.coalesce("is_dir", F.lit(False)) if "is_dir" in files.columns else F.lit(False)).alias("_d"))
    return m.join(now, "source", "left").withColumn("stale", ~F.coalesce("_d", F.lit(False)) & F.coalesce(~F.col("hash").startswith(F.col("source_hash")), F.lit(True))).drop("_d")


def ending(name: str) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)$", 1))


def untracked(files: DataFrame, tracked: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Files of a folder, of an ending that its sources have, that are no source. files: dir, name, file_path; tracked: dir, source.

    Hidden files are left out, and those whose names fit a pattern of NO_SOURCE or of the nearest area's source_exclude (areas: dir, source_exclude).
    """
    kinds = tracked.select("dir", ending("source").alias("ending")).filter("ending <> ''").distinct()
    out = files.filter(~F.col("name").startswith(".")).withColumn("ending", ending("name")).join(kinds, ["dir", "ending"], "left_semi").join(tracked.select(F.col("source").alias("file_path")), "file_path", "left_anti").drop("ending")
    out = out.filter(~excluded(F.col("name"), NO_SOURCE))
    if areas is not None:
        near = nearest_area(out.select("file_path").distinct(), areas).select("file_path", F.coalesce("area.source_exclude", F.array().cast("array<string>")).alias("_p"))
        fits = F.exists("_p", lambda p: F.regexp_like(F.col("name"), glob_column(p)))
        out = out.join(near, "file_path").filter(~fits).drop("_p")
    return out


def stale_dirs(stored: DataFrame, current: DataFrame, changes: DataFrame, new: DataFrame, cards: DataFrame) -> DataFrame:
    """dir, stale. stored, current: dir, fingerprint. Only folders whose fingerprint differs are looked into; one without any card is stale."""
    differs = stored.join(current.withColumnRenamed("fingerprint", "now"), "dir", "left").withColumn("differs", ~F.col("fingerprint").eqNullSafe(F.col("now")))
    bad = changes.filter("stale").select("dir").unionByName(new.select("dir")).distinct().withColumn("bad", F.lit(True))
    has = cards.select("dir").distinct().withColumn("has", F.lit(True))
    return differs.join(bad, "dir", "left").join(has, "dir", "left").select("dir", (F.col("differs") & (F.coalesce("bad", F.lit(False)) | F.col("has").isNull())).alias("stale"))


def totals(dirs: DataFrame) -> DataFrame:
    return dirs.agg(F.count_if("stale").alias("stale"), F.count_if(~F.col("stale")).alias("current"))


def scan(listed: DataFrame, content: DataFrame, heads: DataFrame, cards: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """dir, stale for all managed folders (those with a manifest), in two steps: fingerprints first, then only the folders that differ in full.

    listed: dir, name, file_path, length, mtime_ns of all files; content: file_path and content, asked for sources only; heads: dir, fingerprint;
    cards: dir, kind, source, source_hash, pos. A folder with no cards at all is stale if it differs.
    """
    current = heads.select("dir").distinct().join(fingerprint(listed), "dir", "left").select("dir", F.coalesce("fingerprint", empty_fingerprint()).alias("fingerprint"))
    differing = heads.join(current.withColumnRenamed("fingerprint", "now"), "dir").filter(~F.col("fingerprint").eqNullSafe(F.col("now"))).select("dir").distinct()
    mine = cards.join(differing, "dir", "left_semi")
    sources = mine.filter("coalesce(kind, '') <> 'dir_summary' and coalesce(source_hash, '') <> ''").select("dir", "source").filter("source is not null")
    return stale_dirs(heads, current, changed(mine, content), untracked(listed.join(differing, "dir", "left_semi").select("dir", "name", "file_path"), sources, areas), cards)


def update(dirs: DataFrame, refresh: Callable[[str], object]) -> tuple[int, int]:
    """Call refresh(dir) for each stale folder in order, one after another; how many folders were stale and how many current."""
    t = totals(dirs).first()
    for r in dirs.filter("stale").select("dir").distinct().orderBy("dir").toLocalIterator():
        refresh(r.dir)
    return t.stale, t.current


def hash_matches(content: Column, stored: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256)).startswith(stored)
