"""Packing with a controlled mixture: deficit round-robin over source queues.

Each queue (a source) has the target share of its tokens among all. After w windows of `window` tokens a queue has served
floor(w * window * share) tokens plus one for the largest deficits, so that every window is full, takes each queue's target
within a token, and carries what is owed to the next. That state is a formula in w, so any partition knows the deficits at its
own first window without a pass over the earlier ones.

Sources too small for a queue share one, ordered by each document's fractional place among the tokens of its own source: up to any point of that queue,
each source has given its share within a document.

What is left after the last full window is cut at powers of two, so that no sequence needs padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common, tokens

WINDOW = 4096
#: A source with at least this share of the tokens has a queue of its own (at most as many as this goes into 1); others share one.
OWN_QUEUE = 1 / 256
#: Documents in a part of a source that shares its queue, at most about.
PART_DOCS = 1 << 18
#: Tokens in a cell of a queue, at most about.
CELL_TOKENS = 1 << 26


def muldiv(w: np.ndarray, a: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder of w * a by t, exactly: the product may pass 64 bits, the remainder in wrapped arithmetic doesn't."""
    q = (np.asarray(w, np.longdouble) * a / t).astype(np.int64)
    with np.errstate(over="ignore"):
        r = (np.asarray(w, np.uint64) * np.asarray(a, np.uint64) - q.astype(np.uint64) * np.uint64(t)).astype(np.int64)
    step = np.floor_divide(r, t)
    return q + step, r - step * t


def served(w: np.ndarray, totals: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Tokens each queue has given to the first w windows: a row for each w, summing to w * window."""
    t = int(totals.sum())
    q, r = muldiv(np.asarray(w, np.int64)[:, None] * window, totals[None, :], t)
    owed = np.asarray(w, np.int64) * window - q.sum(1)
    place = np.argsort(np.argsort(-r, axis=1, kind="stable"), axis=1, kind="stable")
    return q + (place < owed[:, None])


def tail_cuts(rest: int) -> np.ndarray:
    """Ends of the sequences after the last full window: powers of two, largest first."""
    return np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]).astype(np.int64) if rest else np.zeros(0, np.int64)


def pieces(start: int, lengths: np.ndarray, queue: int, totals: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Cut documents that stand one after another in a queue from `start` on: (document, start in it, length, sequence, offset)."""
    total = int(totals.sum())
    full = total // window
    ends = start + np.cumsum(lengths)
    begins, last = ends - lengths, int(ends[-1])
    guess = lambda x: int(x * (total / int(totals[queue])) // window)
    lo, hi = max(0, guess(start) - 3), min(full, guess(last) + 3)
    w = np.arange(lo, hi + 1)
    at = served(w, totals, window)  # at the start of each window
    mine = at[:, queue]
    nxt = np.concatenate([at[1:], served(np.array([hi + 1]), totals, window) if hi < full else totals[None, :]])
    before = (nxt - at)[:, :queue].sum(1)  # offset of this queue in each window; the last row may be the tail
    cuts = [begins, mine]
    base = None
    if hi == full and total > full * window:
        # a token's place in the tail is base plus its place in the queue
        base = int(before[-1] - mine[-1])
        cuts.append(tail_cuts(total - full * window) - base)
    cut = np.unique(np.concatenate(cuts))
    cut = cut[(cut >= start) & (cut < last)]
    stop = np.append(cut[1:], last)
    real = stop > cut
    cut, stop = cut[real], stop[real]
    doc = np.searchsorted(ends, cut, "right")
    row = np.searchsorted(mine, cut, "right") - 1
    seq, offset = w[row], before[row] + cut - mine[row]
    if base is not None and (in_tail := seq == full).any():
        place, edges = cut[in_tail] + base, np.concatenate([[0], tail_cuts(total - full * window)])
        k = np.searchsorted(edges, place, "right") - 1
        seq = seq.copy()
        seq[in_tail], offset[in_tail] = full + k, place - edges[k]
    return doc, cut - begins[doc], stop - cut, seq, offset


def spread(rows: DataFrame) -> DataFrame:
    """rows (source, doc_id, th, n_tokens, more) with `place`, from 0 to 1: where among its source's tokens a document stands.

    Places follow from the documents' sizes alone: they are dealt to parts by hash, PART_DOCS or fewer a part, the parts' tokens are summed, and a running sum within each part does the rest. So
    a source is as many tasks as it has parts, and no ids meet there; the ids are shuffled once to their documents' places. Documents of one source, id and ids share a
    place. Within its own stretch a document stands where a hash of its source says, so that sources of a single document lie all over, too.
    """
    one = common.written(rows.groupBy("source", "doc_id", "th").agg(F.sum("n_tokens").alias("n")), "sizes")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_source = common.written(one.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("docs")), "sources")
    most = max(1, min(PART_DOCS, (of_source.agg(F.sum("docs")).first()[0] or 0) // (4 * parts)))
    number = F.xxhash64("doc_id", "th")
    dealt = common.with_group(one, of_source, "source", "docs", number).withColumn("part", F.pmod(number, F.ceil(F.col("docs") / most))).drop("docs")
    sums = common.running(dealt.groupBy("source", "part").agg(F.sum("n").alias("of_part")), ["source"], "part", "of_part").select(F.col("source").alias("_s"), F.col("part").alias("_p"), "begin")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "part").orderBy(F.col("doc_id").asc_nulls_first(), "th").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.pmod(F.xxhash64("source"), F.lit(1 << 30)) / float(1 << 30)
    placed = dealt.withColumn("before", before).join(sums, (F.col("source") == F.col("_s")) & (F.col("part") == F.col("_p")))
    placed = placed.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("th").alias("_h"), ((F.col("begin") + F.col("before") + inside * F.col("n")) / F.col("total")).alias("place"))
    same = (F.col("source") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h"))
    return rows.join(placed, same).select(*rows.columns, "place")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = tokens.TOKENIZER, end_id: int = tokens.END_ID, ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and their ids (little-endian unsigned 32 bits) if asked for.

    Null text is empty (the end id alone), null source a source like any other, equal doc_ids are documents of their own.
    An empty table gives no piece. A queue is cut into cells of about equal size: documents stand in their queue by cell (dealt by a hash of id and ids; in a
    shared queue by their place among their source's tokens, see spread) and then by doc_id. The cells' tokens are summed first, so every cell knows where
    it begins, and the ids are shuffled once, those of a shared queue once more for their places.
    """
    spark = docs.sparkSession
    kind = tokens.id_type(256 ** tokens.id_bytes(tokenizer, end_id), end_id).str
    named = docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    encoded = common.written(tokens.tokenized(named, ["doc_id", "source"], tokenizer, end_id).withColumn("th", F.xxhash64("ids")), "packing")
    by_source = encoded.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    large = sorted(((r.n, r.source) for r in by_source.filter(F.col("n") >= total * OWN_QUEUE).collect()), key=lambda x: (-x[0], x[1]))  # 256 at most
    rest = total - sum(n for n, _ in large)
    totals = [n for n, _ in large]
    shared = len(large)
    if rest * window >= 2 * total or rest and not large:
        totals.append(rest)
    elif rest:  # too few for a token in every window: with the smallest of the others
        shared = len(large) - 1
        totals[shared] += rest
    totals = np.array(totals, np.int64)
    own = F.create_map(*(F.lit(x) for k, (_, s) in enumerate(large) for x in (s, k))) if large else None
    queue = F.coalesce(F.try_element_at(own, F.col("source")), F.lit(shared)) if large else F.lit(shared)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = max(window, min(CELL_TOKENS, total // (4 * n)))
    cells = np.maximum(1, -(-totals // size))
    first_cell = np.cumsum(cells) - cells
    of_queue = lambda values: F.array(*(F.lit(int(x)) for x in values))[F.col("queue")] if len(values) else F.lit(0)
    dealt = encoded.withColumn("queue", queue.cast("int"))
    in_queue = F.pmod(F.xxhash64("doc_id", "th"), of_queue(cells))
    if rest:
        apart = dealt.filter(F.col("queue") != shared).withColumn("place", F.lit(0.0))
        dealt = apart.unionByName(spread(dealt.filter(F.col("queue") == shared)))
        in_queue = F.when(F.col("queue") == shared, F.least(F.floor(F.col("place") * int(cells[shared])), F.lit(int(cells[shared]) - 1))).otherwise(in_queue)
    order = ["cell", *(["place"] if rest else []), F.col("doc_id").asc_nulls_first(), "th"]
    dealt = dealt.withColumn("cell", (of_queue(first_cell) + in_queue).cast("int"))
    begin = np.zeros(int(cells.sum()), np.int64)  # a row for each cell: total / CELL_TOKENS, or four a partition if that's more, and one a queue
    for r in dealt.groupBy("cell").agg(F.sum("n_tokens").alias("n")).collect():
        begin[r.cell] = r.n
    begin = np.cumsum(begin) - begin
    begin -= np.repeat(begin[first_cell], cells)
    begins = spark.sparkContext.broadcast((begin, first_cell, totals))

    def run(batches):
        begin, first_cell, totals = begins.value
        now, at = None, 0
        for batch in batches:
            cell, m = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat = batch.column(3)
            off, data = (np.frombuffer(b, t) for b, t in zip(flat.buffers()[1:], (np.int32, np.uint8), strict=True))
            off = off[flat.offset : flat.offset + len(flat) + 1]
            flat = data[off[0] : off[-1]].view(kind).astype("<u4")
            upto = np.concatenate([[0], np.cumsum(m)])
            edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]])).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now != cell[a]:
                    now = int(cell[a])
                    at = int(begin[now])
                queue = int(np.searchsorted(first_cell, now, "right")) - 1
                doc, s, length, seq, offset = pieces(at, m[a:b], queue, totals, window)
                at += int(upto[b] - upto[a])
                raw = memoryview(flat[upto[a] : upto[b]]).cast("B")
                cut = np.concatenate([[0], np.cumsum(length)]) * 4  # pieces follow one another
                x, y = cut[:-1].tolist(), cut[1:].tolist()
                out = [batch.column(1).take(pa.array(doc + a)), *(pa.array(v, pa.int64()) for v in (s, length, [zlib.crc32(raw[i:j]) for i, j in zip(x, y, strict=True)], m[a:b][doc], seq, offset))]
                if ids:
                    out.append(pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(cut), pa.py_buffer(flat[upto[a] : upto[b]])]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    schema = f"doc_id {named.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * ids
    ordered = dealt.repartitionByRange(n, "cell").sortWithinPartitions(*order).select("cell", "doc_id", "n_tokens", "ids")
    return ordered.mapInArrow(run, schema)
