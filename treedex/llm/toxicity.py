"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's subwords are the word itself and its 3- to 5-grams of characters with its edges marked, hashed into BUCKETS vectors, so that an unseen misspelling
shares most of its vectors with the word. A bag is a window of WORDS consecutive words (steps of half a window); its vectors' mean goes through a linear
softmax. A document's score is that of its most toxic window: a few words in a long text count as they do in a short one.

Training: vectors and softmax by Adagrad over a bounded sample of labelled documents, of each class PER_CLASS. A toxic document teaches through the
windows that look most toxic so far, a clean one through its most toxic and a random window. One document in CALIBRATION of the sample isn't learned from;
on these a logistic curve is fitted that turns margins into scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .sampling import by_label, crc

BUCKETS, DIM, GRAMS, WORDS = 1 << 17, 8, (3, 4, 5), 8
PER_CLASS, EPOCHS, BATCH, RATE, CALIBRATION = 1200, 14, 256, 0.5, 5

_WORD: list[np.ndarray] = []


def _is_word() -> np.ndarray:
    if not _WORD:
        _WORD.append(np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000))
    return _WORD[0]


def subwords(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of every subword, ordered by word; the first word of each text (one more than texts)."""
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    c = np.zeros(int(sizes.sum()) + 1, np.uint32)
    at = np.cumsum(sizes) - sizes
    for a, p in zip(at.tolist(), points, strict=True):
        c[a + 1 : a + 1 + len(p)] = p
    word = _is_word()[c]
    c[~word] = 0  # a boundary; every text begins with one, and one ends the last
    begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    first = np.searchsorted(begin, np.append(at, len(c)))
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), first
    number = np.cumsum(np.concatenate([[False], word[1:] & ~word[:-1]])) - 1
    x = c.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        buckets, owners = [], []
        rolled, inner = x * np.uint64(0x9E3779B97F4A7C15), word
        for n in range(2, max(GRAMS) + 1):
            rolled = (rolled[:-1] ^ (rolled[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :]
            if n in GRAMS:
                # all but the outer two are letters, so that at most the ends are boundaries
                ok = np.ones(len(rolled), bool)
                for k in range(1, n - 1):
                    ok &= word[k : k + len(rolled)]
                i = np.flatnonzero(ok)
                buckets.append(common.mix(rolled[i] + np.uint64(n)) >> np.uint64(47))
                owners.append(number[i + 1])
        end = np.flatnonzero(~word[1:] & word[:-1]) + 1
        p = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(x * common.powers(len(c) + 1)[0][: len(c)], out=p[1:])
        buckets.append(common.mix((p[end] - p[begin]) * common.powers(len(c) + 1)[1][begin] + np.uint64(99)) >> np.uint64(47))
        owners.append(np.arange(len(begin)))
    b, o = np.concatenate(buckets).astype(np.int32), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order], first


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) word of each window, and its text; a text without words has none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WORDS) // (WORDS // 2)) + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    a = first[:-1][text] + k * (WORDS // 2)
    return a, np.minimum(a + WORDS, first[1:][text]), text


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all subwords, the first subword of each word and the first word of each text, a few texts at a time."""
    buckets, edges, firsts, words, total = [], [], [np.zeros(1, np.int64)], 0, 0
    for lo in range(0, len(texts), 32):
        b, o, first = subwords(texts[lo : lo + 32])
        buckets.append(b)
        edges.append(np.searchsorted(o, np.arange(int(first[-1]))) + total)
        firsts.append(first[1:] + words)
        words, total = words + int(first[-1]), total + len(b)
    return np.concatenate(buckets or [np.zeros(0, np.int32)]), np.concatenate([*edges, [total]]), np.concatenate(firsts)


class Model:
    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        rng = np.random.default_rng(seed)
        y = np.array(labels)
        b, edge, first = features(texts)
        wa, wb, wt = windows(first)
        fa, fb = edge[wa], edge[wb]
        vec = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        soft, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        g_vec, g_soft, g_bias = np.full((BUCKETS, DIM), 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        text_at = np.searchsorted(wt, np.arange(len(texts) + 1))
        margin = None
        aside = np.arange(len(texts)) % CALIBRATION == CALIBRATION - 1
        if len(set(y[aside])) < 2:  # too few to set any aside
            aside[:] = False
        for _ in range(EPOCHS if len(set(labels)) == 2 else 0):
            chosen = []
            for t in range(len(texts)):
                a, z = int(text_at[t]), int(text_at[t + 1])
                if a == z or aside[t]:
                    continue
                some = rng.integers(a, z, 2 if margin is None else 1)
                if margin is None:
                    chosen += [*some.tolist()] * (2 if y[t] else 1)
                else:
                    top = a + int(np.argmax(margin[a:z]))
                    chosen += [top, top] if y[t] else [top, int(some[0])]
            chosen = rng.permutation(np.array(chosen))
            for lo in range(0, len(chosen), BATCH):
                w = chosen[lo : lo + BATCH]
                n = (fb - fa)[w]
                idx = b[np.repeat(fa[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                bag = np.repeat(np.arange(len(w)), n)
                start = np.cumsum(n) - n
                h = np.add.reduceat(vec[idx], start, axis=0) / n[:, None]
                z = h @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = p
                d[np.arange(len(w)), y[wt[w]]] -= 1
                d /= len(w)
                up = (d @ soft.T) / n[:, None]
                for g, x, step in ((g_soft, soft, h.T @ d), (g_bias, bias, d.sum(0))):
                    g += step * step
                    x -= RATE * step / np.sqrt(g)
                touched, back = np.unique(idx, return_inverse=True)
                step = np.stack([np.bincount(back, up[bag, k], len(touched)) for k in range(DIM)], 1).astype(np.float32)
                g_vec[touched] += step * step
                vec[touched] -= RATE * 0.2 * step / np.sqrt(g_vec[touched])
            logit = vec @ (soft[:, 1] - soft[:, 0])
            margin = self._margins(logit, float(bias[1] - bias[0]), b, edge, wa, wb)
        self.weight = (vec @ (soft[:, 1] - soft[:, 0])).astype(np.float32)
        self.bias, self.scale, self.shift = float(bias[1] - bias[0]), 1.0, 0.0
        if margin is not None:
            top = np.full(len(texts), self.bias)
            np.maximum.at(top, wt, margin)
            of = aside if aside.any() else ~aside
            self.scale, self.shift = _calibrate(top[of], y[of])

    @staticmethod
    def _margins(weight, bias, b, edge, wa, wb):
        word = np.add.reduceat(weight[b], edge[:-1]) if len(b) else np.zeros(0)  # each word has a subword at least, itself
        total = np.concatenate([[0.0], np.cumsum(word, dtype=np.float64)])
        return (total[wb] - total[wa]) / np.maximum(1, edge[wb] - edge[wa]) + bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        b, edge, first = features(texts)
        wa, wb, wt = windows(first)
        top = np.full(len(texts), -np.inf)
        if len(wt):
            np.maximum.at(top, wt, self._margins(self.weight, self.bias, b, edge, wa, wb))
        top[np.isinf(top)] = self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * top + self.shift, -40, 40)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve by Newton's method, classes weighing the same, slope at least a little above 0."""
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    mean, sd = float(np.average(x, weights=w)), float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))) or 1.0
    z, a, c = (x - mean) / sd, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        g = np.array([(w * (p - y) * z).sum() + 1e-3 * a, (w * (p - y)).sum()])
        r = w * p * (1 - p)
        hess = np.array([[(r * z * z).sum() + 1e-3, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-6]])
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(hess, g), -2, 2)
    a = max(a, 1e-3)
    return a / sd, c - a * mean / sd


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """On about per_class documents of each class, from those labelled whose crc32 of the id doesn't leave rest 0 by 5."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc() % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = by_label(known, "toxic", per_class, 7)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()  # some 2.2 * per_class
    rows = sorted(rows, key=lambda r: (r.doc_id))
    return Model([r.text or "" for r in rows], [r.toxic for r in rows])


def predict(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keep, held_out, score, predicted. A text without words, null too, has the score of an empty bag; rows stay as they are."""
    from .decontaminate import _arrow

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = pa.schema([*((k, _arrow(docs, k)) for k in keep), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            for rows, _, _ in common.text_blocks(batch.column("text")):
                part = batch.slice(rows.start, rows.stop - rows.start)
                s = shared.value.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=schema)

    common.prepare(spark)
    held = F.coalesce(crc() % 5 == 0, F.lit(False)).alias("held_out")
    source = docs.select(*keep, *([] if "text" in keep else ["text"]), held)
    return source.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", held_out boolean, score double, predicted int")
