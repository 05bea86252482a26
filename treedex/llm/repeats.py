"""Exact substring dedup: bytes covered by a string of LENGTH bytes that also starts elsewhere, by suffix arrays over what may repeat.

1. Every LENGTH-byte window picks an anchor: the leftmost of its GRAM-byte grams with the smallest hash, so that equal windows pick equal grams at equal
   places. Windows in a row with one anchor are a segment. Strings repeat only between segments whose anchors' grams are equal; a gram that occurs once repeats
   nothing. Of equal segments of a gram (a kind, told by a hash of its bytes) one body goes on, with the number of its copies.
2. A gram's kinds are one text for the suffix sorting, a kind of several copies twice: words of WORD bytes, aligned at the anchor, so that equal windows have
   equal words. Neighbours in the suffix order (linear grouping, see suffix_array) that share 5 words make a run; two windows are equal exactly if their
   first whole words are in one run and the bytes around those 5 words, 40 in all, are the same. Nothing else decides that a window repeats.
3. A gram with more than HOT kinds is no text to sort at once: its kinds are halved by where the anchor lies in the window. All windows of a half share a
   longer string around the anchor, which is its key; equal windows fall into equal halves with equal keys, again to be sorted, or halved once more.
4. What was decided for a kind goes to all its copies; spans meet their documents, whose other bytes are hashed.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .suffix_array import ranges, suffix_arrays

LENGTH, GRAM, WORD = 200, 32, 32
#: Kinds of a gram sorted as one text; bytes of bodies sorted at once, but for whole texts.
HOT, BLOCK_BODIES = 1000, 6 << 20
#: Bytes of a long text handled at once.
PIECE = 1 << 22


def segments(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, last window, anchor, gram's hash) of each segment; places are bytes of the block."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none, none.view(np.uint64)
    if len(raw) > PIECE + length and len(off) == 2:
        parts = []
        for lo in range(0, len(raw) - length + 1, PIECE):
            hi = min(len(raw), lo + PIECE + length - 1)
            _, a, b, m, h = segments(raw[lo:hi], np.array([0, hi - lo]), length, gram)
            parts.append((np.zeros(len(a), np.int64), a + lo, b + lo, m + lo, h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    p, inverse = common.prefix_hash(raw), common.powers(len(raw) + 1)[1]
    h = common.mix((p[gram:] - p[:-gram]) * inverse[: len(raw) - gram + 1])
    place = np.uint64((1 << 24) - 1)
    anchor = (common.sliding_min(h & ~place | np.arange(len(h), dtype=np.uint64), length - gram + 1) & place).astype(np.int64)
    ends = np.repeat(off[1:], np.diff(off))[: len(anchor)]
    at = np.flatnonzero(ends - np.arange(len(anchor)) >= length)
    if not len(at):
        return none, none, none, none, none.view(np.uint64)
    new = np.concatenate([[True], (anchor[at][1:] != anchor[at][:-1]) | (at[1:] != at[:-1] + 1)])
    k = np.flatnonzero(new)
    a, b = at[k], at[np.append(k[1:], len(at)) - 1]
    m = anchor[a]
    return np.searchsorted(off, a, "right") - 1, a, b, m, h[m]


_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def repeated_windows(body: np.ndarray, off: np.ndarray, anchor: np.ndarray, twice: np.ndarray, lane: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur twice or more among the bodies of one lane: (body, place in it), in order.

    body, off: the bodies' bytes one behind another; anchor: the anchor's place in each; twice: whether a body stands for two; lane: equal for the bodies
    of a text, which stand together.
    """
    eight, around = WORD // 8, length - WORD * ((length - WORD + 1) // WORD)
    which = np.repeat(np.arange(len(anchor)), 1 + twice)
    lens, shift = np.diff(off)[which], anchor[which] % WORD
    n_words = (lens - shift) // WORD
    padded = np.concatenate([body, np.zeros(length, np.uint8)])
    at_byte = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    # each body ends in a symbol of its own, below all words; the last of a lane is the smallest
    own = np.concatenate([[True], lane[which][1:] != lane[which][:-1]])
    first = np.flatnonzero(own)
    count = np.diff(np.append(first, len(which)))
    stops = np.cumsum(n_words + 1) - 1
    text = np.empty(int(stops[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[stops] = False
    word = np.repeat(off[which] + shift, n_words) + WORD * ranges(np.zeros(len(n_words), np.int64), n_words)
    parts = [at_byte[word + 8 * i] for i in range(eight)]
    by = np.lexsort(parts)
    rank = np.empty(len(word), np.int64)
    rank[by] = np.cumsum(np.concatenate([[False], np.any([x[by][1:] != x[by][:-1] for x in parts], axis=0)]))
    text[inside], text[stops] = rank + int(count.max()), np.repeat(count, count) - 1 - ranges(np.zeros(len(count), np.int64), count)
    begin = stops - n_words
    order = suffix_arrays(text, np.append(begin[first], len(text)))
    of = np.repeat(np.arange(len(which)), n_words + 1)
    need = (length - WORD + 1) // WORD
    # a suffix between two that share so many words has as many, so shorter ones can go first
    order = order[stops[of[order]] - order >= need]
    same = np.flatnonzero(lane[which[of[order[1:]]]] == lane[which[of[order[:-1]]]]) + 1 if len(order) else order
    for k in range(need):
        same = same[text[order[same] + k] == text[order[same - 1] + k]]
    new = np.ones(len(order), bool)
    new[same] = False
    run = np.cumsum(new)
    many = np.zeros(len(order), bool)
    many[same], many[same - 1] = True, True
    order, run = order[many], run[many]
    row = of[order]
    word_at = shift[row] + WORD * (order - begin[row])
    once = np.concatenate([[True], which[1:] != which[:-1]])  # a body's second copy has the first one's windows
    hit: list[np.ndarray] = []
    span = 1 << 32
    for r in range(WORD):  # windows whose first whole word is r bytes from their start
        p = word_at - r
        ok = np.flatnonzero((p >= 0) & (p + length <= lens[row]))
        if not len(ok):
            continue
        start = off[which[row[ok]]] + p[ok]
        # the r bytes before the words and those behind them, eight at a time
        ring = []
        for i in range(0, around, 8):
            here, behind = at_byte[start + i], at_byte[start + WORD * need + i]
            mask = _LOW[min(max(r - i, 0), 8)]
            x = here & mask | behind & ~mask
            ring.append(x if i + 8 <= around else x & _LOW[around - i])
        key = ring[0]
        for x in ring[1:]:
            key = common.mix(key) ^ x
        by = np.lexsort((key, run[ok]))
        equal = run[ok][by][1:] == run[ok][by][:-1]
        for x in ring:
            equal &= x[by][1:] == x[by][:-1]
        dup = np.zeros(len(ok), bool)
        dup[by[1:][equal]], dup[by[:-1][equal]] = True, True
        dup &= once[row[ok]]
        hit.append(which[row[ok[dup]]] * span + p[ok[dup]])
    found = np.sort(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
    return found // span, found % span


def _halves(kinds: DataFrame, width: int, length: int) -> DataFrame:
    """Kinds cut so that the anchor's place in the windows of a part lies in one range of so many; h is then the hash of the bytes all these windows share."""
    last, at = F.octet_length("body") - length, F.col("m") - F.col("j") * width
    first, end = F.greatest(at - (width - 1), F.lit(0)), F.least(at, last)
    cut = kinds.withColumn("j", F.explode(F.sequence(F.floor((F.col("m") - last) / width).cast("int"), F.floor(F.col("m") / width).cast("int"))))
    core, body = F.substring("body", at + 1, F.lit(length - width + 1)), F.substring("body", first + 1, end - first + length)
    return cut.select("h0", "s0", F.xxhash64("h", "j", core).alias("h"), F.xxhash64(body).alias("s"), "n", (F.col("at") + first).alias("at"), (F.col("m") - first).alias("m"), body.alias("body"))


def sorted_windows(rows: DataFrame, length: int) -> DataFrame:
    """rows: lane, h, s, n, h0, s0, at, m, body: bodies to sort, a lane at once; those with n > 1 stand for two. Runs of windows that repeat: h, s, n, h0, s0, a, b.

    a and b are first and last window of a run, from the start of the kind (h0, s0) on.
    """
    names = ["h", "s", "n", "h0", "s0"]

    def run(batches):
        held, size = [], 0

        def flush(table):
            lanes, s = (table.column(c).to_numpy() for c in ("lane", "s"))
            again = np.flatnonzero((lanes[1:] == lanes[:-1]) & (s[1:] == s[:-1])) + 1
            if len(again):
                table = table.take(pa.array(np.delete(np.arange(len(lanes)), again)))
            cols = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("lane", "n", "at", "m")}
            raw = table.column("body").combine_chunks()
            raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
            off, data = (np.frombuffer(x, t) for x, t in zip(raw.buffers()[1:], (np.int32, np.uint8), strict=True))
            off = off[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            which, place = repeated_windows(data[off[0] : off[-1]], off - off[0], cols["m"].astype(np.int64), cols["n"] > 1, cols["lane"], length)
            new = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (place[1:] != place[:-1] + 1)])) if len(which) else which
            last = np.append(new[1:], len(which)) - 1 if len(new) else new
            at = pa.array(which[new])
            begin = cols["at"].astype(np.int64)[which[new]]
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(at) for c in names), pa.array((begin + place[new]).astype(np.int32)), pa.array((begin + place[last]).astype(np.int32))], [*names, "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("body").nbytes
            if size >= BLOCK_BODIES:
                table = pa.Table.from_batches(held)
                lanes = table.column("lane").to_numpy()
                cut = int(np.flatnonzero(lanes[1:] != lanes[:-1]).max(initial=-1)) + 1  # the last lane may go on
                if cut:
                    yield flush(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("body").nbytes for b in held)
        if held:
            yield flush(pa.Table.from_batches(held))

    in_order = rows.repartition("lane").sortWithinPartitions("lane", "s").select("lane", *names, "at", "m", "body")
    return in_order.mapInArrow(run, "h bigint, s bigint, n bigint, h0 bigint, s0 bigint, a int, b int")


def _gathered(df: DataFrame) -> DataFrame:
    """df in partitions in proportion to cores, or to an eighth of the shuffle partitions where these are many: a task does several, one after another, and writes one file.

    There are some thirty tables here, many of them small, and a file costs more than its bytes: for each one the JVM starts processes, beside which its memory counts twice.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def _kept(df: DataFrame, tag: str) -> DataFrame:
    return common.written(_gathered(df), tag)


def repeats(docs: DataFrame, length: int = LENGTH, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with text the remaining bytes as text_kept.

    Null text is empty. Documents with one doc_id stay apart by their text; rows repeated as a whole repeat each other. Texts of fewer bytes lose
    nothing. An empty table gives no row.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    key = ["doc_id", "th"]
    doc_kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for rows, raw, off in common.text_blocks(batch.column("text")):
                r, a, b, _, h = segments(raw, off, length)
                if not len(r):
                    continue
                body, digest = raw.tobytes(), xxhash.xxh3_64_intdigest
                s = np.array([digest(body[x:y]) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)], np.uint64)
                who = pa.array(r + rows.start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(who), batch.column("th").take(who), pa.array(h.view(np.int64)), pa.array(s.view(np.int64)), pa.array((a - off[r]).astype(np.int32)), pa.array((b - off[r]).astype(np.int32))], ["doc_id", "th", "h", "s", "a", "b"]
                )

    found = _kept(keyed.filter(F.octet_length("text") >= length).mapInArrow(find, f"doc_id {doc_kind}, th bigint, h bigint, s bigint, a int, b int"), "segments")
    grams = _kept(found.groupBy("h", "s").agg(F.count("*").alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("n > 1").select("h", "kinds"), "grams")
    common.tidy(spark)
    shared = _kept(found.join(grams, "h"), "shared")
    common.dropped(found)
    common.dropped(grams)
    common.tidy(spark)
    counts = shared.groupBy("h", "s").agg(F.count("*").alias("n"), F.min(F.struct(*key, "a", "b", "kinds")).alias("r")).select("h", "s", "n", "r.*")

    # the bytes of one of each kind of segment, from its document
    asked = _kept(counts.groupBy(*key).agg(F.collect_list(F.struct("h", "s", "n", "a", "b", "kinds")).alias("want")), "asked")

    def cut(batches):
        for batch in batches:
            want, texts = batch.column("want"), batch.column("text").to_pylist()
            who = np.repeat(np.arange(len(want)), pc.list_value_length(want).to_numpy(zero_copy_only=False))
            items = want.flatten()
            a, b = (items.field(x).to_numpy() for x in "ab")
            found = []
            for i, lo, hi in zip(range(len(texts)), np.searchsorted(who, np.arange(len(texts))), np.searchsorted(who, np.arange(len(texts)), "right"), strict=True):
                body, texts[i] = texts[i].encode(), None
                found += [body[x:y] for x, y in zip(a[lo:hi].tolist(), (b[lo:hi] + length).tolist(), strict=True)]
            # the anchor is in all windows of the segment and decided by any: here by the first, many of them side by side
            m = np.zeros(len(found), np.int32)
            step = common.BLOCK_BYTES // length
            for lo in range(0, len(found), step):
                raw = np.frombuffer(b"".join(x[:length] for x in found[lo : lo + step]), np.uint8)
                r, first, _, anchor, _ = segments(raw, np.arange(0, len(raw) + 1, length), length)
                m[lo + r] = anchor - first
            step = max(1, (4 << 20) // (2 * length))  # bodies in a batch, so that its size is bounded
            for lo in range(0, len(found), step):
                one = items.slice(lo, step)
                yield pa.RecordBatch.from_arrays([*(one.field(x) for x in "hsn"), pa.array(m[lo : lo + step]), one.field("kinds"), pa.array(found[lo : lo + step], pa.binary())], ["h", "s", "n", "m", "kinds", "body"])

    bodies = keyed.join(asked, keyed["doc_id"].eqNullSafe(asked["doc_id"]) & (keyed["th"] == asked["th"])).select("text", "want")
    # rows with one id and text are one document twice, whose kinds come twice: sorting and halving leave one
    bodies = bodies.mapInArrow(cut, "h bigint, s bigint, n bigint, m int, kinds bigint, body binary")
    bodies = _kept(bodies.withColumns({"h0": F.col("h"), "s0": F.col("s"), "at": F.lit(0)}), "bodies")
    common.dropped(asked)
    common.tidy(spark)
    columns = ["lane", "h", "s", "n", "h0", "s0", "at", "m", "body"]
    hot_gram, copies = F.col("kinds") > HOT, F.xxhash64("h", "s")
    # a hot gram's kinds of several copies are a text each; elsewhere a gram's kinds are one
    ready = [bodies.filter(~hot_gram | (F.col("n") > 1)).withColumn("lane", F.when(hot_gram, copies).otherwise(F.col("h"))).select(*columns)]
    gone: list[DataFrame] = [asked]
    parts, width = [], length - GRAM + 1
    hot = bodies.filter(hot_gram).dropDuplicates(["h", "s"])
    while width > 1 and not hot.isEmpty():
        width = -(-width // 2)
        halves = _kept(_halves(hot, width, length), "halves")
        distinct = _kept(halves.groupBy("h", "s").agg(F.sum("n").alias("n"), F.first(F.struct("h0", "s0", "at", "m", "body")).alias("r")).select("h", "s", "n", "r.*"), "distinct")
        # written, so that the join reads both sides anew and a hot key's halves can be split among tasks
        keys = _kept(distinct.groupBy("h").agg(F.count("*").alias("kinds")), "keys")
        next_ = _kept(distinct.join(keys, "h").filter("kinds > 1 or n > 1").select("h", "s", "n", "h0", "s0", "at", "m", "body", "kinds"), "halved")
        ready.append(next_.filter(~hot_gram | (F.col("n") > 1)).withColumn("lane", F.when(hot_gram, copies).otherwise(F.col("h"))).select(*columns))
        # halves of kinds that have but one copy; those of others went with their kinds
        parts.append(halves.filter("n = 1").select("h", "s", F.col("h0").alias("h1"), F.col("s0").alias("s1"), F.col("at").alias("a1"), (F.col("at") + F.octet_length("body") - length).alias("b1")))
        hot = next_.filter(hot_gram)
        gone += [halves, distinct, keys, next_]
        common.tidy(spark)
    if parts:
        ready.append(hot.withColumn("lane", F.col("h")).select(*columns))  # single windows with one hash
    decided = _kept(sorted_windows(reduce(DataFrame.unionAll, ready), length), "decided")
    runs = decided.filter("n = 1 or h = h0 and s = s0").select("h0", "s0", "a", "b")
    for p in parts:
        whole = decided.filter("n > 1 and not (h = h0 and s = s0)").select("h", "s").distinct()
        runs = runs.unionAll(p.join(whole, ["h", "s"]).select(F.col("h1").alias("h0"), F.col("s1").alias("s0"), F.col("a1").alias("a"), F.col("b1").alias("b")))
    # written, so that the copies of a kind that has very many can be split among tasks
    of_kind = _kept(runs.groupBy(F.col("h0").alias("h"), F.col("s0").alias("s")).agg(F.collect_set(F.struct("a", "b")).alias("runs")), "runs")
    spans = shared.join(of_kind, ["h", "s"]).select(*key, F.explode(F.transform("runs", lambda r: F.struct((F.col("a") + r["a"]).alias("a"), (F.col("a") + r["b"]).alias("b")))).alias("x"))
    spans = _kept(spans.groupBy(*key).agg(F.collect_set("x").alias("spans")), "spans")
    for t in (shared, bodies, decided, of_kind, *gone[1:]):
        common.dropped(t)
    common.tidy(spark)

    def keep(batches):
        for batch in batches:
            rows = []
            for content, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                body = (content or "").encode()
                kept, n, removed = [], 0, 0
                start = stop = 0
                for x in sorted((x["a"], x["b"] + length) for x in found or ()):
                    if x[0] > stop or not n:  # runs that touch are one
                        if n:
                            removed += stop - start
                        kept.append(body[stop if n else 0 : x[0]])
                        start, n = x[0], n + 1
                        stop = x[1]
                    stop = max(stop, x[1])
                if n:
                    removed += stop - start
                kept.append(body[stop:])
                rest = b"".join(kept)
                assert len(rest) + removed == len(body)
                rows.append((len(body), removed, n, hashlib.sha256(rest).hexdigest(), *([rest] if text else [])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["text_kept"] if text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if text else [])]
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["doc_id"]) & (keyed["th"] == spans["th"]), "left").select(keyed["doc_id"], "text", "spans")
    return _gathered(joined.mapInArrow(keep, f"doc_id {doc_kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", text_kept binary" * text))
