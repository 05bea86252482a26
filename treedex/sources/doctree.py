"""Document trees as a data source, for batches and streams: spark.read.format("doctree"), spark.readStream.format("doctree").

Options: include and exclude (paths and patterns, one a line), content (true; false lists only), parts (folders listed apart, 32), settle (of a stream: seconds that a file must be old, 1).
Rows are SCHEMA of sources.files, content and ctime_ns. Hidden folders are read like any other; areas and manifests are among the files.

Filters on ftype, dir and beginnings of file_path (or dir) reach the listing: a folder that can't hold a wanted file is never opened, and a file of another type isn't read. That needs the
session setting spark.sql.python.filterPushdown.enabled; without it Spark filters afterwards.

A stream's offset is a time: a batch has the files whose status changed (so also those moved in, with an old time of writing) after the last batch's and up to its own. Nothing is listed to
find an offset, tasks do it; a restart goes on from the checkpoint's, so each change comes once. Deleted files don't come; see plans.store.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith

from treedex.sources import files as source

SCHEMA = source.SCHEMA + ", content string, ctime_ns bigint"
_ARROW = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in SCHEMA.split(", ")])


@dataclass
class Folder(InputPartition):
    here: str
    root: str
    deep: bool
    after: int | None = None
    upto: int | None = None

    def __post_init__(self):
        super().__init__(self.here)


class _Tree:
    """Lists and reads folders; what is wanted of them as far as it is known."""

    def __init__(self, options: dict, known: dict[str, str]):
        lines = lambda k: [x.strip() for x in options.get(k, "").split("\n") if x.strip()]
        self.include, self.exclude, self.known = lines("include") or lines("path"), lines("exclude"), known
        self.content, self.few = options.get("content", "true").lower() != "false", int(options.get("parts", "32"))
        self.types: set[str] | None = None
        self.below: list[str] = []  # beginnings of paths
        self.dirs: set[str] | None = None

    def holds(self, folder: str) -> bool:
        """Whether a wanted file may be in a folder or below it."""
        inside = folder.rstrip("/") + "/"
        return all(inside.startswith(p) or p.startswith(inside) for p in self.below) and (self.dirs is None or any((d + "/").startswith(inside) for d in self.dirs))

    def folders(self) -> list[tuple[str, str, bool]]:
        return source.work(self.include, self.exclude, self.few, self.holds)

    def rows(self, part: Folder):
        open_ = [part.here]
        while open_:
            here = open_.pop()
            if part.deep:
                open_ += reversed(source.below(here, self.exclude, self.holds))
            if self.dirs is not None and here not in self.dirs:
                continue
            try:
                names = [e.name for e in os.scandir(here) if e.is_file()]
            except OSError:
                continue
            kinds = sorted(self.types) if self.types is not None else sorted(set(self.known.values()))
            for row in source.files_of(here, names, part.root, self.exclude, kinds, None, self.known):
                if (self.types is None or row[3] in self.types) and all(row[0].startswith(p) for p in self.below):
                    yield row

    def read(self, part: Folder):
        held, size = [], 0
        for row in self.rows(part):
            try:
                changed = os.stat(row[0]).st_ctime_ns
            except OSError:
                continue
            if part.upto is not None and not part.after < changed <= part.upto:
                continue
            text = source.text_of(row[0]) if self.content else None
            held.append((*row, text, changed))
            size += len(text or "") + 200
            if size > source.BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, known: dict[str, str]):
        self.tree = _Tree(options, known)

    def pushFilters(self, filters):
        t = self.tree
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == "ftype" and isinstance(f, EqualTo | In):
                kinds = {f.value} if isinstance(f, EqualTo) else set(f.value)
                t.types = kinds if t.types is None else t.types & kinds
            elif name == "dir" and isinstance(f, EqualTo | In):
                dirs = {f.value} if isinstance(f, EqualTo) else set(f.value)
                t.dirs = dirs if t.dirs is None else t.dirs & dirs
            elif name in ("file_path", "dir") and isinstance(f, StringStartsWith):
                t.below.append(f.value)
                if name == "dir":  # a path begins so, too; Spark looks at the folder itself
                    yield f
            elif name == "file_path" and isinstance(f, EqualTo):
                t.below.append(f.value)
                yield f
            else:
                yield f

    def partitions(self):
        return [Folder(*w) for w in self.tree.folders()]

    def read(self, partition):
        if partition is not None:
            yield from self.tree.read(partition)


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict, known: dict[str, str]):
        self.tree, self.settle = _Tree(options, known), float(options.get("settle", "1"))

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        return {"upto": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict):
        return [Folder(*w, start["upto"], end["upto"]) for w in self.tree.folders()]

    def read(self, partition):
        yield from self.tree.read(partition)


class DocTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "doctree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TreeReader(dict(self.options), dict(source.FILE_TYPES))

    def streamReader(self, schema):
        return TreeStream(dict(self.options), dict(source.FILE_TYPES))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocTree)
