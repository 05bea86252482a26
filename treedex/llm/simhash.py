"""SimHash near-duplicates with pivot distance tables.

Fingerprints: 64 bits by majority over the hashes of a text's word shingles. Equal fingerprints are one node. Links are pairs of nodes at
most `radius` bits apart. Nodes are dealt into cells that hold every such pair: with radius + 2 bands of bits, two fingerprints
radius bits apart agree on two bands at least, so there is a cell for each two bands and their bits. With radius + m bands they agree on m: the more nodes,
the more bands key a cell (key_bands), so that cells don't grow with the table; no pair is lost at any number. In a cell, each fingerprint's
Hamming distances to PIVOTS reference fingerprints form a table; a pair whose distances to some pivot differ by more than radius can't be
linked (triangle inequality) and is discarded; the rest is verified by its own distance. A cell of more than CELL nodes is cut into
chunks, and each two chunks meet in a task of their own. Tasks give spanning stars, not pairs.

similar() asks for a similarity of shingle sets instead. Two texts of similarity J differ in about acos(2J / (1 + J)) / pi of their bits, too many of 64 for such
cells and too roughly estimated by 64. It takes WIDE words of fingerprint and TABLES cells a node, each keyed by KEY_BITS bits drawn from all; the chance
that two nodes so many bits apart never meet is stated with the constants. As fingerprints only estimate, the pairs that tasks give are compared by their shingle
sets; so that few need to be, a task gives a minimum spanning forest of its pairs by distance. Where a forest's edge fails, another pair may still hold its group
together: in such groups tasks have the sets too, compare every pair between parts not yet joined and give a forest of the pairs that hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
PIVOTS, CELL = 16, 2048
#: A node's copy in a cell costs about as much as so many comparisons.
COPY = 100
IS_WORD = common.word_class([(0x20, 0x20), (0x09, 0x0D)])
#: For similar(): words a shingle, words a fingerprint, its cells and the bits that key them, pivots. Of pairs of similarity 0.8 (38 to 39 bits of 256 apart on
#: average) 0.95 meet in a cell, of 0.85 (33) 0.99, of 0.9 (26) all but 1 in 10,000.
WIDE_SHINGLE, SIMILARITY, WIDE, TABLES, KEY_BITS, WIDE_PIVOTS = 5, 0.8, 4, 56, 18, 4
#: Bits beyond the expected distance, in its standard deviations, at which a pair still counts: 0.84 of the pairs at the very similarity do.
SLACK = 1.0


def majority(h: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n hashes from begin on: a number whose bits are those set in over half of them.

    Eight bits at a time are summed side by side in the bytes of a word, over at most 255 hashes, before the sums are widened.
    """
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    cut = np.repeat(begin, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    votes = np.empty((len(cut), 64), np.int32)
    for b in range(8):
        votes[:, b::8] = np.add.reduceat(h >> np.uint64(b) & np.uint64(0x0101010101010101), cut).view(np.uint8).reshape(-1, 8)
    votes = np.add.reduceat(votes, first, axis=0) if len(cut) > len(n) else votes
    return np.packbits(votes * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """A row's fingerprint: a bit is 1 if set in over half of the hashes of its shingles, repeats included; without words 0."""
    low = common.LOWER[raw]
    starts, ends, first = common.words(low, off, IS_WORD)
    n_words = np.diff(first)
    out = np.zeros(len(off) - 1, np.uint64)
    if not len(starts):
        return out
    # words with one blank after each, so that a shingle is one stretch of bytes
    keep = IS_WORD[low]
    keep[ends[ends < len(low)]] = True
    low = low.copy()
    sep = ends[(ends < len(low))]
    sep = sep[~IS_WORD[low[sep]]]
    low[sep] = 32
    place = np.cumsum(keep) - keep
    body = low[keep].tobytes()
    s = place[starts]
    e = s + (ends - starts)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    total = int(n.sum())
    row_first = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    i = np.repeat(first[:-1], n) + np.arange(total) - row_first[row]
    last = np.minimum(i + shingle, first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(body[a:b], SEED) for a, b in zip(s[i].tolist(), e[last].tolist(), strict=True)], np.uint64)
    some = np.flatnonzero(n)
    out[some] = majority(h, row_first[some], n[some])
    return out


def fingerprinted(docs: DataFrame, keep: list[str] = ["doc_id"], shingle: int = SHINGLE) -> DataFrame:  # noqa: B006
    """keep and `fp`, the fingerprint as a signed 64-bit number. Null text has no words."""
    from .decontaminate import _arrow

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    fn = common.by_block(lambda raw, off: {"fp": pa.array(fingerprints(raw, off, shingle).view(np.int64))}, pa.schema([*((k, _arrow(docs, k)) for k in keep), ("fp", pa.int64())]), keep)
    return docs.select(*keep, "text").mapInArrow(fn, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", fp bigint")


def distinct_shingles(raw: np.ndarray, off: np.ndarray, shingle: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct shingles, in order by row, and their rows; fewer words are one shingle, none give none."""
    low = common.LOWER[raw]
    starts, ends, first = common.words(low, off, IS_WORD)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = common.span_hash(common.prefix_hash(low), starts, ends)
    n_words = np.diff(first)
    hashes, rows = [], []
    for size in range(1, shingle + 1):  # rows of fewer words are whole
        some = np.flatnonzero(n_words >= shingle if size == shingle else n_words == size)
        n = n_words[some] - size + 1
        if not len(some):
            continue
        at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h = np.full(len(at), np.uint64(size))
        for i in range(size):
            h = h * np.uint64(0x9DDFEA08EB382D69) + word[at + i]
        hashes.append(common.mix(h))
        rows.append(np.repeat(some, n))
    h, row = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[new], row[new]


def wide_fingerprints(raw: np.ndarray, off: np.ndarray, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> np.ndarray:
    """A row's fingerprint of so many 64-bit words: a bit is 1 if set in over half of the hashes of its distinct shingles; a row without words has 0."""
    out = np.zeros((len(off) - 1, words), np.uint64)
    h, row = distinct_shingles(raw, off, shingle)
    if not len(h):
        return out
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.diff(np.append(begin, len(row)))
    for j in range(words):
        out[row[begin], j] = majority(common.mix(h + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)), begin, n)
    return out


def wide_radius(similarity: float = SIMILARITY, bits: int = 64 * WIDE, slack: float = SLACK) -> int:
    """Differing bits up to which a pair counts as of the similarity."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints: of numbers, or of rows of words."""
    d = np.bitwise_count(a ^ b)
    return d if d.ndim == 1 else d.sum(-1, dtype=np.int16)


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 64, n, np.uint64)


def linked(fp: np.ndarray, groups: np.ndarray, radius: int, table: np.ndarray, reduce: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most radius apart within runs of equal `groups`; fp: numbers, or rows of words; table: distances to pivots.

    Where there are very many, reduce (star, if it isn't given) makes fewer of them on the way.
    """
    reduce = reduce or (lambda i, j: star(i, j, fp))
    edge = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    size = np.diff(edge)
    left, right = [], []

    def verify(i, j):
        for k in range(table.shape[1]):
            near = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[near], j[near]
            if len(i) < 64:
                break
        near = np.abs(table[i] - table[j]).max(1, initial=0) <= radius
        i, j = i[near], j[near]
        near = distance(fp[i], fp[j]) <= radius
        left.append(i[near])
        right.append(j[near])

    small = np.repeat(size <= 64, size)
    end = np.repeat(edge[1:], size)
    at = np.arange(len(fp))
    for step in range(1, 64):
        i = np.flatnonzero(small & (at + step < end))
        if not len(i):
            break
        verify(i, i + step)
    for a, b in zip(edge[:-1][size > 64].tolist(), edge[1:][size > 64].tolist(), strict=True):
        order = a + np.argsort(table[a:b, 0], kind="stable")
        first = table[order, 0]
        stop = np.searchsorted(first, first + radius, "right")
        for lo in range(0, b - a, 256):
            hi = min(b - a, lo + 256)
            n = stop[lo:hi] - np.arange(lo, hi) - 1
            i = np.repeat(np.arange(lo, hi), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            verify(order[i], order[j])
            if sum(map(len, left)) > 1 << 20:
                left[:], right[:] = ([x] for x in reduce(np.concatenate(left), np.concatenate(right)))
    return (np.concatenate(left), np.concatenate(right)) if left else (at[:0], at[:0])


def star(left: np.ndarray, right: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star of each component of some links between indexes."""
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(len(fp)))
    return node, label[node]


def forest(left: np.ndarray, right: np.ndarray, weight: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of some links between indexes. Equal weights are ordered by names, so forests of parts of a graph hold that of the whole."""
    order = np.lexsort((np.maximum(name[left], name[right]), np.minimum(name[left], name[right]), weight))
    left, right = left[order], right[order]
    taken, rank, label = np.zeros(len(left), bool), np.arange(len(left)), np.arange(len(name))
    while True:
        a, b = label[left], label[right]
        between = a != b
        if not between.any():
            return left[taken], right[taken]
        best = np.full(len(name), len(left))
        np.minimum.at(best, a[between], rank[between])
        np.minimum.at(best, b[between], rank[between])
        taken[best[best < len(left)]] = True
        node, low = star(left[taken], right[taken], name)
        label = np.arange(len(name))
        label[node] = low


def key_bands(nodes: int, radius: int) -> int:
    """How many of radius + m bands key a cell, at the least cost a node: a copy for each choice of bands, and the nodes that meet it there if bits are even."""
    return min(range(2, 9), key=lambda m: math.comb(radius + m, m) * (COPY + nodes / 2 ** (64 * m / (radius + m))))


def links(nodes: DataFrame, radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """nodes: fp, distinct. Edges (a, b) between fingerprints that connect all those at most radius bits apart. agree: bands that key a cell, by default from the number of nodes."""
    agree = agree or key_bands(nodes.count(), radius)
    bands = radius + agree
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    mask = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(bands)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*(F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(signed(sum(mask[i] for i in some)))).alias("bits")) for k, some in enumerate(combinations(range(bands), agree))))
    keyed = common.written(nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.combo", "k.bits"), "cells")
    sizes = common.written(keyed.groupBy("combo", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    c = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    dealt = (
        keyed.join(sizes, ["combo", "bits"]).select("fp", "combo", "bits", c.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("fp", F.xxhash64("combo", "bits", F.least("c", "other"), F.greatest("c", "other")).alias("cell"))
    )
    reference = pivots()

    def run(batches):
        held, size = [], 0

        def flush(cells, fps):
            table = np.bitwise_count(fps[:, None] ^ reference[None, :]).astype(np.int16)
            i, j = linked(fps, cells, radius, table)
            i, j = star(i, j, fps)
            return pa.RecordBatch.from_arrays([pa.array(fps[i].view(np.int64)), pa.array(fps[j].view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            size += batch.num_rows
            if size >= 1 << 14:
                cells, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(cells[1:] != cells[:-1]).max(initial=-1)) + 1  # the last cell may go on
                if cut:
                    yield flush(cells[:cut], fps[:cut])
                held, size = [(cells[cut:], fps[cut:])], len(cells) - cut
        if size:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.repartition(F.col("cell")).sortWithinPartitions("cell").select("cell", "fp").mapInArrow(run, "a bigint, b bigint").distinct()


def cell_keys(fp: np.ndarray) -> np.ndarray:
    """For rows of WIDE words: the key of each one's cell in each table (a row a table)."""
    rng = np.random.default_rng(7)
    drawn = np.stack([rng.permutation(64 * WIDE)[:KEY_BITS] for _ in range(TABLES)])
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8 * WIDE), axis=1, bitorder="little").astype(np.float64)
    weight = 2.0 ** np.arange(KEY_BITS)
    return np.stack([(bits[:, drawn[t]] @ weight).astype(np.int64) | t << KEY_BITS for t in range(TABLES)])


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as arrays of distinct numbers, are of a similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    same = len(np.intersect1d(x, y, assume_unique=True))
    return same / max(1, len(x) + len(y) - same) >= similarity


def arrays(column: pa.Array) -> np.ndarray:
    """A list column as numpy arrays, None for null."""
    out = np.empty(len(column), object)
    if column.null_count < len(column):
        for i, x in enumerate(column):
            out[i] = x.values.to_numpy() if x.is_valid else None
    return out


def wide_links(nodes: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """nodes: node, fp (binary, distinct). Pairs (a, b) of nodes that share a cell and are at most radius bits apart, of each cell a minimum spanning forest by distance.

    With a similarity, nodes have part and shingles (an array of hashes) too, and only pairs of different parts whose shingles are so similar are links.
    """
    if similarity is None:
        nodes = nodes.withColumn("part", F.lit(None).cast("bigint")).withColumn("shingles", F.lit(None).cast("array<bigint>"))
    names = ["node", "fp", "part", "shingles"]
    kind = "node bigint, fp binary, part bigint, shingles array<bigint>"

    def key(batches):
        for batch in batches:
            keys = cell_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WIDE))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(keys[t]), *batch.columns], ["key", *names])

    keyed = nodes.select(names).mapInArrow(key, "key bigint, " + kind)
    # only cells of more than CELL nodes are cut; their list is short
    hot = common.written(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL), "hot-cells")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    c = F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = keyed.join(hot, "key", "left").select(*names, "key", F.coalesce(c, F.lit(0)).alias("c"), F.explode(F.sequence(F.lit(0), F.coalesce(chunks - 1, F.lit(0)))).alias("other"))
    dealt = dealt.select(*names, F.xxhash64("key", F.least("c", "other"), F.greatest("c", "other")).alias("cell"))
    reference = np.random.default_rng(20).integers(0, 1 << 64, (WIDE_PIVOTS, WIDE), np.uint64)

    def run(batches):
        held, size = [], 0

        def flush(cells, node, fps, part, sets):
            one = np.concatenate([[True], cells[1:] != cells[:-1], [True]])
            some = ~(one[:-1] & one[1:])  # alone in its cell: linked to nothing
            cells, node, fps, part, sets = (x[some] for x in (cells, node, fps, part, sets))
            table = np.stack([distance(fps, np.broadcast_to(r, fps.shape)) for r in reference], 1).astype(np.int16)

            def fewer(i, j):
                if similarity is not None:
                    other = part[i] != part[j]
                    i, j = i[other], j[other]
                    holds = np.array([alike(sets[x], sets[y], similarity) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
                    i, j = i[holds], j[holds]
                return forest(i, j, distance(fps[i], fps[j]), node)

            i, j = fewer(*linked(fps, cells, radius, table, fewer))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE), batch.column(3).fill_null(-1).to_numpy(), arrays(batch.column(4))))
            size += batch.num_rows + (batch.nbytes >> 11)
            if size >= 1 << 14:
                cells, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(cells[1:] != cells[:-1]).max(initial=-1)) + 1  # the last cell may go on
                if cut:
                    yield flush(cells[:cut], *(x[:cut] for x in rest))
                held, size = [(cells[cut:], *(x[cut:] for x in rest))], len(cells) - cut
        if size:
            yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.repartition(F.col("cell")).sortWithinPartitions("cell").select("cell", *names).mapInArrow(run, "a bigint, b bigint").distinct()


#: A row by its id and text.
_ROW = {"_k1": lambda: F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), "_k2": lambda: F.hash("doc_id", F.coalesce("text", F.lit("")))}


def compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b of nodes) whose picks' texts have sets of shingles of the similarity; and the nodes' shingles. nodes: node, pick (a row of docs by id and text)."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    picks = nodes.join(degree, "node").select("node", "n", "pick._k1", "pick._k2")
    # the exchange is by id and text, so many copies of one text don't meet
    texts = docs.select("text", *(x().alias(k) for k, x in _ROW.items())).join(picks, list(_ROW)).dropDuplicates(list(_ROW))

    def fn(raw, off):
        h, row = distinct_shingles(raw, off, shingle)
        return {"shingles": common.lists(h.view(np.int64), np.searchsorted(row, np.arange(len(off))), pa.int64())}

    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    sets = common.written(texts.select("node", "n", "text").mapInArrow(common.by_block(fn, schema, ["node", "n"]), "node bigint, n bigint, shingles array<bigint>"), "shingle-sets")
    both = common.with_group(pairs, sets.select(F.col("node").alias("a"), "n", F.col("shingles").alias("_x")), "a", "n", F.xxhash64("b")).drop("n")
    both = common.with_group(both, sets.select(F.col("node").alias("b"), "n", F.col("shingles").alias("_y")), "b", "n", F.xxhash64("a")).drop("n")
    same = F.size(F.array_intersect("_x", "_y"))
    out = common.written(both.filter(same / (F.size("_x") + F.size("_y") - same) >= similarity).select("a", "b"), "compared")
    return out, sets


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, fp (binary), component_id (the smallest doc_id of the group), root (a number of the group) and keep, of groups linked by texts of the similarity or more.

    Texts of one fingerprint are taken as alike; other links are checked by the texts' sets of shingles, one text a fingerprint. Texts without words, null ones too, have one fingerprint. Equal doc_ids keep a row each. A null doc_id names no group unless it has no other. An empty table
    gives no row.
    """
    from .decontaminate import _arrow

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = ["doc_id", *(k for k in keep if k != "doc_id")]

    def fn(raw, off):
        fp = wide_fingerprints(raw, off, shingle)
        return {"fp": pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(np.arange(len(fp) + 1, dtype=np.int32) * 8 * WIDE), pa.py_buffer(np.ascontiguousarray(fp))])}

    schema = pa.schema([*((k, _arrow(docs, k)) for k in columns), ("_k1", pa.int64()), ("_k2", pa.int32()), ("fp", pa.binary())])
    rows = docs.select(*columns, *(x().alias(k) for k, x in _ROW.items()), "text")
    found = common.written(rows.mapInArrow(common.by_block(fn, schema, [*columns, *_ROW]), ", ".join(f"`{k}` {kinds[k]}" for k in columns) + ", _k1 bigint, _k2 int, fp binary"), "wide-fingerprints")
    nodes = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min(F.struct(*_ROW)).alias("pick")).withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    radius, old = wide_radius(similarity), [nodes]
    pairs = common.written(wide_links(nodes, radius), "wide-pairs")
    edges, sets = compared(pairs, nodes, docs, similarity, shingle)
    whole, root = components(pairs), components(edges)
    old += [pairs, edges, sets, whole, root]
    # groups of the forest that have come apart
    part = nodes.select("node", "fp")
    for table, name in ((whole, "whole"), (root, "part")):
        part = part.join(table.select(F.col("a").alias("node"), F.col("b").alias(name)), "node", "left").withColumn(name, F.coalesce(name, "node"))
    part = common.written(part, "wide-parts")
    apart = part.groupBy("whole").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("whole")
    more = common.written(wide_links(part.join(apart, "whole", "left_semi").join(sets.select("node", "shingles"), "node"), radius, similarity), "wide-rest")
    old += [part, more]
    root = components(edges.unionByName(more))
    named = common.written(nodes.join(root.select(F.col("a").alias("node"), F.col("b").alias("r")), "node", "left").select("fp", "doc", F.coalesce("r", "node").alias("root")), "wide-roots")
    least = common.written(named.groupBy("root").agg(F.min("doc").alias("component_id")), "wide-least")
    by_fp = common.written(named.join(least, "root").select("fp", "component_id", "root"), "wide-groups")
    for t in (*old, named, least, root):
        common.dropped(t)
    return found.join(by_fp, "fp").select(*columns, "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """doc_id, fp, component_id: the smallest doc_id that links of at most radius bits reach, itself included; then keep and `root`, the component's smallest fingerprint, if keep is given.

    Texts without words, null ones too, have fingerprint 0 and are linked like any other. Equal doc_ids keep a row each. A null doc_id is
    never a component's name unless it has no other. An empty table gives no row.
    """
    found = common.written(fingerprinted(docs, ["doc_id", *keep], shingle), "fingerprints")
    nodes = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("doc")), "nodes")
    root = components(links(nodes.select("fp"), radius))
    named = common.written(nodes.join(root.select(F.col("a").alias("fp"), F.col("b").alias("r")), "fp", "left").select("fp", "doc", F.coalesce("r", "fp").alias("root")), "roots")
    least = common.written(named.groupBy("root").agg(F.min("doc").alias("component_id")), "least-doc")
    more = [*keep, "root"] if keep else []
    by_fp = common.written(named.join(least, "root").select("fp", "component_id", *more[-1:]), "by-fp")
    for t in (nodes, root, named, least):
        common.dropped(t)
    return found.join(by_fp, "fp").select("doc_id", "fp", "component_id", *more)
