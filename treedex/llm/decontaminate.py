"""Benchmark decontamination by winnowing.

Texts are words; every GRAM consecutive words have a hash, and the smallest hash in each WINNOW consecutive grams is kept, for
test items and documents alike. Two texts that share GRAM + WINNOW - 1 = 13 words have a kept fingerprint in common, so joining
fingerprints misses no shared window. A hit is extended to every 13-word window around it, which is compared word for word
(by a 128-bit hash of its bytes). Items of fewer words are one window: their own length is the gram, and every gram is kept.

The benchmark's fingerprints are broadcast in blocks of at most BLOCK_TEXT bytes of item text; a larger benchmark takes several passes
whose hits are put together by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW, GRAM = 13, 5
WINNOW = WINDOW - GRAM + 1
#: A document is contaminated if it is hit and at least one word in so many is.
SHARE = 20
BLOCK_TEXT = 16 << 20
#: A window's 128-bit hash.
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])
IS_WORD = common.word_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes."""
    if len(words) < k:
        return words[:0]
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9DDFEA08EB382D69) + words[i : len(words) - k + 1 + i]
    return common.mix(out)


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """True where a gram is the smallest in some window of w (of equal ones, all)."""
    low = common.sliding_min(grams, w)
    if len(low) == 0:
        return np.zeros(len(grams), bool)
    pad = np.zeros(w - 1, np.uint64)
    # the largest of the minima of the windows around a gram is the gram itself, if any is
    most = ~common.sliding_min(~np.concatenate([pad, low, pad]), w)
    return most == grams


class Index:
    """Windows of some items: fingerprints to look for, and by a window's hash the items that have it. All in sorted arrays: some 5 bytes for a byte of item text."""

    def __init__(self, items: list[tuple[str | None, str]]):
        self.fingerprints, self.short = np.zeros(0, np.uint64), {}
        self.names = [item_id for item_id, _ in items]
        prints, short, keys, owner = [], {}, [], []
        for number, (_, text) in enumerate(items):
            raw = common.LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, _ = common.words(raw, np.array([0, len(raw)]), IS_WORD)
            n = len(starts)
            if not n:
                continue
            size = min(n, WINDOW)
            hashes = common.span_hash(common.prefix_hash(raw), starts, ends)
            if n < WINDOW:
                short.setdefault(n, []).append(gram_hashes(hashes, n))
            else:
                grams = gram_hashes(hashes, GRAM)
                prints.append(grams[winnow(grams, WINNOW)])
            body, s, e = raw.tobytes(), starts.tolist(), ends.tolist()
            own = np.unique(np.frombuffer(b"".join(window_key(body, s, e, i, size) for i in range(n - size + 1)), KEY))
            keys.append(own)
            owner.append(np.full(len(own), number, np.int32))
        self.fingerprints = np.unique(np.concatenate(prints)) if prints else self.fingerprints
        self.short = {n: np.unique(np.concatenate(x)) for n, x in short.items()}
        every, owner = np.concatenate(keys or [np.zeros(0, KEY)]), np.concatenate(owner or [np.zeros(0, np.int32)])
        order = np.argsort(every, order=("a", "b"), kind="stable")
        self.a, self.b, self.owner = every["a"][order], every["b"][order], owner[order]

    def find(self, key: bytes) -> set:
        """Ids of the items that have a window."""
        k = np.frombuffer(key, KEY)[0]
        lo, hi = np.searchsorted(self.a, k["a"], "left"), np.searchsorted(self.a, k["a"], "right")
        return {self.names[i] for i in self.owner[lo:hi][self.b[lo:hi] == k["b"]].tolist()}


def window_key(body: bytes, starts: list[int], ends: list[int], i: int, size: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(body[starts[j] : ends[j]] for j in range(i, i + size)))


def _member(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def hits(raw: np.ndarray, off: np.ndarray, index: Index) -> list[tuple[int, np.ndarray, set]]:
    """For each row: its number of words, which are hit (start and end of runs, in words), the items found."""
    raw = common.LOWER[raw]
    starts, ends, first = common.words(raw, off, IS_WORD)
    hashes = common.span_hash(common.prefix_hash(raw), starts, ends)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    maybe: list[tuple[np.ndarray, int]] = []  # first words of windows to compare, and their size
    for size, gram, w, prints in [(WINDOW, GRAM, WINNOW, index.fingerprints), *((n, n, 1, x) for n, x in index.short.items())]:
        grams = gram_hashes(hashes, gram)
        # kept grams of a row are those of its own windows; grams that run into the next row are of no window
        inside = row[: len(grams)] == row[gram - 1 :] if len(grams) else np.zeros(0, bool)
        kept = winnow(grams, w) if w > 1 else np.ones(len(grams), bool)
        if w > 1 and len(grams):
            # around a row's edge, windows of other rows may hide one of its own grams: keep all grams there
            edge = np.zeros(len(grams) + 1, np.int64)
            for b in first[1:-1]:
                edge[max(0, b - w - gram) : min(len(grams), b + w)] = 1
            edge[: w], edge[-w - 1 :] = 1, 1
            kept |= edge[:-1] > 0
        at = np.flatnonzero(kept & inside)
        at = at[_member(grams[at], prints)]
        if len(at):
            s = np.unique((at[:, None] - np.arange(size - gram + 1)).ravel())
            s = s[(s >= 0) & (s + size <= len(row))]
            maybe.append((s[row[s] == row[s + size - 1]], size))
    found: dict[int, tuple[list, set]] = {}
    body = raw.tobytes() if maybe else b""
    for s, size in maybe:
        for i in s.tolist():
            lo = [int(x) for x in starts[i : i + size]]
            items = index.find(window_key(body, lo, ends[i : i + size].tolist(), 0, size))
            if items:
                spans, names = found.setdefault(int(row[i]), ([], set()))
                spans.append((i - int(first[row[i]]), i - int(first[row[i]]) + size))
                names |= items
    return [(int(first[r + 1] - first[r]), *found.get(r, ([], set()))) for r in range(len(off) - 1)]


def _covered(spans: list) -> int:
    n, at = 0, 0
    for a, b in sorted(spans):
        n += max(0, b - max(a, at))
        at = max(at, b)
    return n


def finish(n_words: int, spans: list, items: set) -> tuple:
    """n_hit, n_items, items_sha256, contaminated."""
    n_hit = _covered(spans)
    names = sorted(x for x in items if x is not None)
    return n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and SHARE * n_hit >= n_words


RESULT = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] = ["doc_id"], block_text: int = BLOCK_TEXT) -> DataFrame:  # noqa: B006
    """keep and, for each document: n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words, so are never contaminated; an item without words, or null, is no window; repeated items count once; an item
    whose id is null hits but isn't counted. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_text))
    plain = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep)
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    arrow = pa.schema([(k, _arrow(docs, k)) for k in keep] + RESULT)
    if blocks == 1:
        shared = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.collect()]))  # block_text bytes at most

        def fn(raw, off):
            rows = [(n, *finish(n, spans, names)) for n, spans, names in hits(raw, off, shared.value)]
            return {name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(RESULT)}

        return source.mapInArrow(common.by_block(fn, arrow, keep), f"{schema}, " + ", ".join(f"{k} {t}" for k, t in plain.items()))
    # several passes: each document's hits of all passes are put together by a number of its row
    numbered = common.written(source.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    parts = []
    for b in range(blocks):
        of = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in of.collect()]))

        def fn(raw, off, shared=shared):
            rows = hits(raw, off, shared.value)
            return {"n_words": pa.array([r[0] for r in rows], pa.int64()), "spans": pa.array([[x for s in r[1] for x in s] for r in rows], pa.list_(pa.int64())), "names": pa.array([list(r[2]) for r in rows], pa.list_(pa.string()))}

        parts.append(numbered.select("_row", "text").mapInArrow(common.by_block(fn, pa.schema([("_row", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("names", pa.list_(pa.string()))]), ["_row"]), "_row bigint, n_words bigint, spans array<bigint>, names array<string>"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    merged = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("names")).alias("names"))  # as many rows as passes

    def put(batches):
        for batch in batches:
            x = batch.to_pydict()
            rows = [(n, *finish(n, list(zip(s[::2], s[1::2], strict=True)), set(names))) for n, s, names in zip(x["n_words"], x["spans"], x["names"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(RESULT))], ["_row", *plain])

    done = merged.mapInArrow(put, "_row bigint, " + ", ".join(f"{k} {t}" for k, t in plain.items()))
    return numbered.select("_row", *keep).join(done, "_row").select(*keep, *plain)


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
