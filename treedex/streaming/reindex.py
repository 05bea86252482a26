"""Incremental re-indexing: a stream of changed files, parsed and handed on batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from treedex.functions.text import base_name, file_type, is_generated, parent_dir
from treedex.plans import store
from treedex.sources import doctree


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """New and changed files of a folder (not hidden ones, which Spark's readers skip), as sources.files gives them."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    path = F.regexp_replace("path", "^file:(//)?", "")
    f = raw.select(path.alias("file_path"), "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    f = f.withColumns({"dir": parent_dir(F.col("file_path")), "name": base_name(F.col("file_path"))}).withColumn("ftype", file_type(F.col("name")))
    return f.filter(F.col("ftype").isNotNull() & F.col("content").isNotNull() & ~is_generated(F.col("content")))


def changed_documents(spark: SparkSession, include: list[str], exclude: list[str] = [], settle: float = 1) -> DataFrame:  # noqa: B006
    """New and changed files of folders, hidden ones among them (so cards and areas), by the library's own data source; see sources.doctree."""
    doctree.register(spark)
    f = spark.readStream.format("doctree").option("include", "\n".join(include)).option("exclude", "\n".join(exclude)).option("settle", str(settle)).load()
    return f.filter(F.col("content").isNotNull() & ~is_generated(F.col("content")))


def keep_views(spark: SparkSession, include: list[str], path: str, checkpoint: str, exclude: list[str] = [], settle: float = 1, available_now: bool = True):  # noqa: B006
    """Start a query that keeps the views at path up to date with new and changed files; deleted files go at the next store.sync()."""
    q = changed_documents(spark, include, exclude, settle).writeStream.foreachBatch(store.into(store.ViewStore(spark, path))).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()


def reindex(spark: SparkSession, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None], available_now: bool = True):
    """Start a query that gives `then` each batch's files; a batch comes again after a failure, so `then` should replace by file_path."""
    q = changed_files(spark, folder).writeStream.foreachBatch(then).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if available_now else q).start()
