"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file holds blocks. A block's ids are ranks by corpus frequency, the most frequent 0, so that most take one byte. Each value
takes 1 to 4 bytes; two bits tell how many, four values to a control byte, and control bytes stand apart from data bytes.
Reading finds all lengths with one numpy table lookup over the control bytes. Files are Parquet tables of self-contained
blocks (any store Spark reads will do), beside a table of the ids by rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common, tokens

#: Ids in a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of each of the four values under a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[: len(v)] = code
    q = padded.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(lens) - lens
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        m = lens > k
        if m.any():
            out[m] |= raw[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def rank_table(encoded: DataFrame, kind: str) -> DataFrame:
    """id, n: how often each id occurs. Counted per task with numpy; at most vocabulary x tasks rows are shuffled."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=len(total))
                c[: len(total)] += total
                total = c
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return encoded.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def id_types(docs: DataFrame) -> tuple[pa.DataType, str]:
    """The type of doc_id, which may be any that sorts, for Arrow and for Spark."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    return to_arrow_type(kind), kind.simpleString()


def write(docs: DataFrame, path: str, tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID) -> None:
    """Write path/blocks and path/ranks: all documents' ids in ascending doc_id order (nulls first; equal doc_ids by a hash of their ids).

    Null text is empty, so its document holds the end id alone. An empty table gives empty files.
    """
    spark = docs.sparkSession
    kind = tokens.id_type(256 ** tokens.id_bytes(tokenizer, end_id), end_id).str
    encoded = common.written(tokens.tokenized(docs, ["doc_id"], tokenizer, end_id), "ids")
    ranked = sorted(((r.n, -r.id) for r in rank_table(encoded, kind).collect()), reverse=True)  # at most the vocabulary
    by_rank = np.array([-i for _, i in ranked], np.int64)
    spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(by_rank)], "rank bigint, id bigint").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    id_type, id_kind = id_types(docs)

    def blocks(batches):
        from pyspark import TaskContext

        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids = np.concatenate([np.frombuffer(x, kind) for _, x in held])
            control, data = encode(rank_of[ids])
            docs, n = [d for d, _ in held], [len(x) // np.dtype(kind).itemsize for _, x in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (before, pa.int64()), (docs, pa.list_(id_type)), (n, pa.list_(pa.int64())), (len(ids), pa.int64()), (control, pa.binary()), (data, pa.binary()))],
                ["part", "before", "doc_ids", "doc_tokens", "n_ids", "control", "data"],
            )

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((d, x))
                size += len(x) // np.dtype(kind).itemsize
                if size >= BLOCK_IDS:
                    yield block()
                    before, held, size = before + size, [], 0
        if held:
            yield block()

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("ids")
    (
        encoded.select("doc_id", "ids").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
        .mapInArrow(blocks, f"part int, before bigint, doc_ids array<{id_kind}>, doc_tokens array<bigint>, n_ids bigint, control binary, data binary")
        .write.parquet(f"{path}/blocks")
    )
    common.dropped(encoded)


def read(spark, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids before it), n_tokens, ids (array of unsigned ids)."""
    return _read(spark, path, "ids array<bigint>", lambda xs: pa.array([x.tolist() for x in xs], pa.list_(pa.int64())))


def digests(spark, path: str) -> DataFrame:
    """One row a document from the files: doc_id, start, n_tokens, ids_crc32."""
    return _read(spark, path, "ids_crc32 bigint", lambda xs: pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in xs], pa.int64()))


def _read(spark, path: str, column: str, made) -> DataFrame:
    blocks, name = spark.read.parquet(f"{path}/blocks"), column.split()[0]
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)  # at most the vocabulary
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row for each task that wrote; a block knows its place in its task's
    first = dict(zip([x[0] for x in totals], np.cumsum([0, *(x[1] for x in totals)])[:-1].tolist(), strict=True))

    def run(batches):
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("doc_ids"))
            for i, b in enumerate(batch.to_pylist()):
                ids = by_rank[decode(b["control"], b["data"], b["n_ids"])]
                n = np.array(b["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [own[i].values, pa.array(first[b["part"]] + b["before"] + ends - n, pa.int64()), pa.array(n, pa.int64()), made(np.split(ids, ends[:-1]))], ["doc_id", "start", "n_tokens", name]
                )

    return blocks.mapInArrow(run, f"doc_id {id_kind}, start bigint, n_tokens bigint, {column}")
