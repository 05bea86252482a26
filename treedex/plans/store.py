"""Views kept by file in tables, brought up to date batch by batch.

What a file alone decides (its entry, nodes, tags, card fields, area settings) is a row of a table with the file's path and the batch that wrote it. A batch writes the rows of new and
changed files, then its changes: each such file, and each deleted one as a tombstone. A batch counts once its changes are there; until then nobody reads it, and doing it again replaces it. A
file's rows are those of the last batch that names it, unless that is a tombstone. So a change costs what the changed files cost; views over several files (domains, groups, terms,
keywords) are computed from the tables when asked for, without parsing anything again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex.config import Config
from treedex.operators import keywords
from treedex.plans.index import KnowledgeIndex
from treedex.plans.lineage import cut
from treedex.sources import files as source

TABLES = ("files", "nodes", "tags", "cards", "areas")
#: What tells that a file is another than the one that was indexed.
STATE = ("length", "mtime_ns")


class ViewStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- folders of batches

    def _entries(self, path: str) -> list[str]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def batches(self) -> list[int]:
        """Numbers of the batches that count, those that a later one has taken up left out."""
        done = sorted(int(x.split("=")[1]) for x in self._entries(f"{self.path}/changes") if x.startswith("batch=") and "_SUCCESS" in self._entries(f"{self.path}/changes/{x}"))
        whole = [b for b in done if f"batch={b}" in self._entries(f"{self.path}/whole")]
        return [b for b in done if not whole or b >= whole[-1]]

    def _read(self, name: str) -> DataFrame | None:
        found = [b for b in self.batches() if f"batch={b}" in self._entries(f"{self.path}/{name}")]
        out = None
        for b in found:  # a folder each: unfinished ones are never listed
            one = self.spark.read.parquet(f"{self.path}/{name}/batch={b}").withColumn("batch", F.lit(b).cast("bigint"))
            out = one if out is None else out.unionByName(one)
        return out

    def live(self) -> DataFrame | None:
        """file_path, batch: files that are there, with the batch that has their rows."""
        changes = self._read("changes")
        if changes is None:
            return None
        return changes.groupBy("file_path").agg(F.max_by("gone", "batch").alias("gone"), F.max("batch").alias("batch")).filter("not gone").drop("gone")

    def table(self, name: str) -> DataFrame:
        """The rows of a table that hold now."""
        rows = self._read(name)
        if rows is None:
            raise ValueError(f"nothing is kept at {self.path}")
        return rows.join(self.live(), ["file_path", "batch"], "left_semi").drop("batch")

    # --- changes

    def update(self, changed: DataFrame, gone: DataFrame | None = None, batch: int | None = None) -> int:
        """changed: files as sources.files.discover gives them, whole; gone: file_path. The batch's number: the next, unless it is given; a number again replaces what that batch wrote."""
        done = self.batches()
        batch = (done[-1] + 1 if done else 0) if batch is None else batch
        for name in ("changes", "whole"):
            self._remove(f"{self.path}/{name}/batch={batch}")  # from here on it doesn't count
        files = cut(changed.select(*source.COLUMNS, "content"))
        index = KnowledgeIndex(files.filter(~F.col("ftype").isin("area", "manifest")), source.areas_of(files), Config(["."]))
        area_path = F.concat("dir", F.lit("/.kb/kb.yml"))
        made = {
            "files": files.drop("content"), "nodes": index.nodes, "tags": index.file_tags(), "cards": index.cards, "areas": source.areas_of(files).select(area_path.alias("file_path"), "dir", "domain", "source_exclude"),
            "changes": files.select("file_path", F.lit(False).alias("gone")).unionByName(gone.select("file_path", F.lit(True).alias("gone")) if gone is not None else files.limit(0).select("file_path", F.lit(True).alias("gone"))),
        }
        for name in (*TABLES, "changes"):  # changes last: they make the batch count
            made[name].write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        return batch

    def sync(self, include: list[str], exclude: list[str] | None = None, types: list[str] | None = None, output: str | None = None) -> tuple[int, int]:
        """Bring the tables up to date with folders: only files that are new, or of another size or time, are read. How many files changed and how many are gone."""
        now = cut(source.listed(self.spark, include, exclude, types, output))
        live = self.live()
        if live is None:
            changed, gone = now, None
        else:
            held = self.table("files").select("file_path", *(F.col(c).alias(f"_{c}") for c in STATE))
            same = F.lit(True)
            for c in STATE:
                same = same & (F.col(c) == F.col(f"_{c}"))
            changed = now.join(held, "file_path", "left").filter(~F.coalesce(same, F.lit(False))).select(now.columns)
            gone = held.join(now, "file_path", "left_anti").select("file_path")
        read = source.read(changed).withColumn("_ok", F.col("content").isNotNull() & ~F.contains(F.substring("content", 1, source.MARKER_WINDOW), F.lit(source.MARKER)))
        read = cut(read)
        lost = read.filter(~F.coalesce("_ok", F.lit(False))).select("file_path")  # changed into something that isn't indexed
        if gone is not None:
            lost = gone.unionByName(lost.join(held, "file_path", "left_semi"))
            lost = cut(lost)
        good = read.filter("_ok").drop("_ok")
        counts = good.count(), (lost.count() if gone is not None else 0)
        if any(counts) or live is None:
            self.update(good, lost if gone is not None else None)
        return counts

    def compact(self) -> int:
        """Write what holds now as one batch; earlier ones are no longer read. Their folders stay until drop_old()."""
        batch = self.batches()[-1] + 1
        self._remove(f"{self.path}/changes/batch={batch}")
        live = cut(self.live().select("file_path", F.lit(False).alias("gone")))
        for name in TABLES:
            self.table(name).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/whole/batch={batch}")  # says that no earlier batch is needed, once the changes are there
        live.write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch}")
        return batch

    def drop_old(self) -> None:
        """Delete batches that a later one has taken up; no reader may be at work on them."""
        kept = {f"batch={b}" for b in self.batches()}
        for name in ("changes", "whole", *TABLES):
            for x in self._entries(f"{self.path}/{name}"):
                if x not in kept:
                    self._remove(f"{self.path}/{name}/{x}")

    def index(self, config: Config | None = None, keyword_rows: keywords.Keywords | None = None) -> StoredIndex:
        return StoredIndex(self, config, keyword_rows)


class StoredIndex(KnowledgeIndex):
    """An index over the kept tables: no file is read or parsed."""

    def __init__(self, store: ViewStore, config: Config | None = None, keyword_rows: keywords.Keywords | None = None):
        files = store.table("files").filter(~F.col("ftype").isin("area", "manifest"))
        super().__init__(files, store.table("areas").drop("file_path"), config, keyword_rows)
        self.store = store

    @cached_property
    def nodes(self) -> DataFrame:
        return self.store.table("nodes")

    @cached_property
    def cards(self) -> DataFrame:
        return self.store.table("cards")

    def file_tags(self) -> DataFrame:
        return self.store.table("tags")

    def invalid(self) -> DataFrame:
        """Files without a node: what their handler finds nothing in as far as the tables can say."""
        return self.files.select("file_path", "ftype").join(self.nodes, "file_path", "left_anti")


def into(store: ViewStore):
    """What a stream does with each batch's files (see streaming.reindex): a batch again replaces itself, an empty one leaves no trace."""

    def then(files: DataFrame, number: int) -> None:
        if not files.isEmpty():
            store.update(files, batch=number)

    return then
