"""Shared helpers: the cluster's shared folder, written intermediate tables, byte-level text blocks."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Text bytes handled at once by a Python worker; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows in an Arrow batch, so that a batch of long texts fits a worker.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Session settings every operator here relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where nothing is set and Spark runs on one machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_treedex_shared", None)
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="treedex-shared-")
        sc._treedex_shared = path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/treedex/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as a table in the shared folder and reread: lineage ends there and nothing above runs twice."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._treedex_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that no later action reads."""
    remove(df.sparkSession, df._treedex_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def with_group(rows: DataFrame, groups: DataFrame, key: str, n_rows: str, deal: Column) -> DataFrame:
    """rows with the columns of their group: groups has a row for each value of key (null too) and its number of rows. A row of rows whose key isn't there is left out.

    A group of more than its share of the rows, one in so many as Spark has shuffle partitions, is dealt over all of them by `deal`, any column of whole numbers; there are fewer such groups
    than partitions, which bounds what is broadcast and how often a group's row is copied.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = groups.agg(F.sum(n_rows)).first()[0] or 0
    large = F.col(n_rows) * parts > total
    names = groups.filter(large).select(F.col(key).alias("_large"), F.lit(True).alias("_is"))
    dealt = rows.join(F.broadcast(names), F.col(key).eqNullSafe(F.col("_large")), "left").withColumn("_deal", F.when(F.col("_is"), F.pmod(deal, F.lit(parts))).otherwise(0).cast("int"))
    copies = groups.withColumn("_copy", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).withColumnRenamed(key, "_key")
    return dealt.join(copies, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_deal") == F.col("_copy"))).drop("_large", "_is", "_deal", "_copy", "_key")


def running(sums: DataFrame, by: list[str], at: str, value: str, block: int = 32) -> DataFrame:
    """sums with `begin`: the sum of the rows of `by` before each in order of `at`, whole numbers that aren't negative. Null-safe.

    Rows are added up within blocks of `at` first, then the blocks, so no task has all rows of one `by` one after another.
    """
    before = lambda c, keys, order: F.coalesce(F.sum(c).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_block", F.floor(F.col(at) / block))
    blocks = sums.groupBy(*by, "_block").agg(F.sum(value).alias("_of"))
    blocks = blocks.select(*(F.col(c).alias(f"_b_{c}") for c in by), F.col("_block").alias("_bb"), before("_of", by, "_block").alias("_upto"))
    inside = sums.withColumn("_in", before(value, [*by, "_block"], at))
    same = F.col("_block") == F.col("_bb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return inside.join(blocks, same).withColumn("begin", F.col("_upto") + F.col("_in")).drop("_block", "_bb", "_upto", "_in", *(f"_b_{c}" for c in by))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_blocks(text: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Split a string array into blocks of about BLOCK_BYTES: (rows, their bytes, offsets from 0). Null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if len(text) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    _, off, data = text.buffers()
    off = np.frombuffer(off, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK_BYTES, "right")) - 1)
        yield slice(i, j), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def by_block(fn: Callable, schema: pa.Schema, keep: list[str], text: str = "text") -> Callable:
    """A mapInArrow function: fn(bytes, offsets) -> dict of columns, one entry a row; keep goes along unchanged."""

    def run(batches):
        for batch in batches:
            for rows, raw, off in text_blocks(batch.column(text)):
                cols = {k: batch.column(k).slice(rows.start, rows.stop - rows.start) for k in keep}
                cols |= fn(raw, off)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)

    return run


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """A table by byte: true in words. Every byte of a multi-byte character is 0x80 or more, so ASCII classes hold on bytes."""
    out = np.ones(256, bool)
    for a, b in excluded:
        out[a : b + 1] = False
    return out


def words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each row (as offsets, one more than rows)."""
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[:-1] = inside
    edge[1:] ^= inside
    edge[0] = len(raw) > 0 and inside[0]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    cut = np.unique(inner[inside[inner - 1] & inside[inner]]) if len(inner) else inner
    at = np.flatnonzero(edge)
    if len(cut):  # a word touching a row's end and another touching the next row's start
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, off)


_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and its inverse modulo 2**64, i < n; kept at block size."""
    size = max(BLOCK_BYTES + 1, n)
    if size not in _POW or len(_POW[size][0]) < n:
        b = np.full(size, _B)
        b[0] = 1
        inv = np.full(size, np.uint64(pow(int(_B), -1, 1 << 64)))
        inv[0] = 1
        made = np.multiply.accumulate(b), np.multiply.accumulate(inv)
        if size > BLOCK_BYTES + 1:
            return made
        _POW[size] = made
    return _POW[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of raw[t] * B**t, i <= t < j."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they lie."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive entries, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
