"""Language identification with string kernels.

Kernel: blended-spectrum presence, k(x, y) = |G(x) and G(y)| / sqrt(|G(x)| |G(y)|) for the sets G of 1- to 3-grams of lower-case characters.
Nystrom: landmarks L give features k(x, L) K_LL^(-1/2). One-versus-rest kernel ridge regression on them. A batch is scored by matrix products: presence
rows times the landmarks' presence columns, folded with the regression's weights.

Characters: the OWN letters that are most frequent in any one language of the training sample have codes of their own, other letters share OTHER codes by
their place in Unicode, so that scripts are told apart, and whatever isn't a letter is a boundary; runs of boundaries count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common
from .sampling import FULL_LABELS, by_label, crc

ALPHABET, OTHER = 64, 13
OWN = ALPHABET - OTHER - 1
#: Labelled documents in the training sample for each language, landmarks for each language, ridge penalty.
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 24, 1e-2
SIZES = (ALPHABET, ALPHABET**2, ALPHABET**3)
SPACE = sum(SIZES)

_LETTER: list[np.ndarray] = []
#: One row of flags by n-gram, false between uses.
_SEEN: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: true for letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def alphabet(shares: dict[str, dict[int, float]]) -> np.ndarray:
    """By code point: the letter's code. shares: by language, each letter's share of its letters."""
    share = np.zeros(0x110000)
    for of_letter in shares.values():
        at = np.fromiter(of_letter, np.int64, len(of_letter))
        share[at] = np.maximum(share[at], np.fromiter(of_letter.values(), float, len(of_letter)))
    top = np.argsort(-share, kind="stable")[:OWN]
    top = top[share[top] > 0]
    codes = np.zeros(0x110000, np.uint8)
    at = np.arange(0x110000)
    block = np.where(at < 0x2000, at >> 7, 64 + (at >> 13))  # about a script each: those beyond are large
    codes[letters()] = (ALPHABET - OTHER + block % OTHER)[letters()]
    codes[top] = np.arange(1, len(top) + 1)
    return codes


def letter_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters of a text and how often it has each."""
    c, n = np.unique(code_points(text), return_counts=True)
    has = letters()[c]
    return c[has], n[has]


def grams(text: str, codes: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams that a text has, ascending."""
    c = codes[code_points(text)].astype(np.int32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])] if len(c) else c
    two = c[:-1] * ALPHABET + c[1:]
    if not _SEEN:
        _SEEN.append(np.zeros(SPACE, bool))
    seen = _SEEN[0]
    seen[c] = True
    seen[SIZES[0] + two] = True
    seen[SIZES[0] + SIZES[1] + two[:-1] * ALPHABET + c[2:]] = True
    seen[0] = False
    found = np.flatnonzero(seen).astype(np.int32)
    seen[found] = False
    return found


class Landmarks:
    """Gram sets of the landmark texts as lists by gram, so that a text's kernel values cost its grams' lists and no dense row."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([max(1, len(x)) for x in sets], float)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.int32)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.owner, self.first = owner[order], np.append(first, len(flat))

    def kernel(self, found: np.ndarray) -> np.ndarray:
        """k(x, l) for each landmark l."""
        at = np.searchsorted(self.grams, found)
        at = at[(at < len(self.grams)) & (self.grams[np.minimum(at, len(self.grams) - 1)] == found)] if len(self.grams) else at[:0]
        a, n = self.first[at], self.first[at + 1] - self.first[at] if len(at) else np.zeros(0, np.int64)
        places = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.zeros(0, np.int64)
        common_ = np.bincount(self.owner[places], minlength=len(self.sets)).astype(float)
        return common_ / np.sqrt(self.sizes * max(1, len(found)))


class Model:
    """Learned from texts at once, or from landmarks and blocks of kernel rows (learned)."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 1):
        shares, counts = {}, {}
        for t, y in zip(texts, langs, strict=True):
            for c, n in zip(*(x.tolist() for x in letter_counts(t)), strict=True):
                of = counts.setdefault(y, {})
                of[c] = of.get(c, 0) + n
        shares = {y: {c: n / sum(of.values()) for c, n in of.items()} for y, of in counts.items()}
        codes, languages = alphabet(shares), sorted(set(langs))
        sets = [grams(t, codes) for t in texts]
        rng = np.random.default_rng(seed)
        marks = [i for x in languages for i in rng.permutation(np.flatnonzero(np.array(langs) == x))[: per_language(len(languages))]]
        land = Landmarks([sets[i] for i in marks])
        self.learned(codes, languages, land, {x: langs.count(x) for x in languages}, [(np.array([land.kernel(x) for x in sets]).reshape(len(sets), len(marks)), langs)])

    def learned(self, codes: np.ndarray, languages: list[str], land: Landmarks, counts: dict[str, int], blocks) -> Model:
        """blocks: (kernel rows, their languages). Only sums over rows are held, as large as the landmarks squared."""
        self.codes, self.languages, m = codes, languages, len(land.sets)
        if not m:
            self.grams, self.weights, self.bias = np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0)
            return self
        gram = np.array([land.kernel(x) for x in land.sets])
        w, v = np.linalg.eigh(gram + 1e-8 * np.eye(m))
        root = (v / np.sqrt(np.maximum(w, 1e-8))) @ v.T
        # each language weighs the same
        total, mean, target = float(len(languages)), np.zeros(m), np.zeros(len(languages))
        square, cross = np.zeros((m, m)), np.zeros((m, len(languages)))
        for k, langs in blocks:
            phi, y = k @ root, np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
            weight = np.array([1 / counts[x] for x in langs])[:, None]
            mean, target = mean + (phi * weight).sum(0), target + (y * weight).sum(0)
            square, cross = square + phi.T @ (phi * weight), cross + phi.T @ (y * weight)
        mean, target = mean / total, target / total
        beta = np.linalg.solve(square - total * np.outer(mean, mean) + RIDGE * np.eye(m), cross - total * np.outer(mean, target))
        self.bias = target - mean @ beta
        self.grams, folded = land.grams, (root @ beta) / np.sqrt(land.sizes)[:, None]
        self.weights = np.zeros((len(self.grams), len(languages)), np.float32)
        for i, x in enumerate(land.sets):
            self.weights[np.searchsorted(self.grams, x)] += folded[i].astype(np.float32)
        return self

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        has = [bool(t) and bool(letters()[code_points(t)].any()) for t in texts]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        at = [i for i, h in enumerate(has) if h] if len(self.languages) else []
        column = np.full(SPACE, len(self.grams), np.int32)  # the last column is of grams that no landmark has
        column[self.grams] = np.arange(len(self.grams))
        for lo in range(0, len(at), 256):
            rows = at[lo : lo + 256]
            x, n = np.zeros((len(rows), len(self.grams) + 1), np.float32), np.ones(len(rows))
            for j, i in enumerate(rows):
                p = grams(texts[i], self.codes)
                n[j], x[j, column[p]] = max(1, len(p)), 1
            s = (x[:, :-1] @ self.weights) / np.sqrt(n)[:, None] + self.bias
            best = s.argmax(1)
            for j, i in enumerate(rows):
                langs[i], scores[i] = self.languages[best[j]], float(min(1.0, max(0.0, (s[j, best[j]] + 1) / 2)))
        return langs, scores


def per_language(n_languages: int) -> int:
    """Landmarks of each language, fewer beyond FULL_LABELS languages."""
    return max(1, min(LANDMARKS, FULL_LABELS * LANDMARKS // max(1, n_languages)))


def fit(docs: DataFrame, sample: int = PER_LANGUAGE) -> Model:
    """On about `sample` documents of each language, fewer where there are over FULL_LABELS, from those with a language whose crc32 of the id leaves another rest by 4 than 2. Ids of any type.

    The sample's texts stay in tasks. The driver gets letters by language, the gram sets of the landmarks (LANDMARKS a language) and a row of kernel values for each document, block by
    block, so it holds what follows from the numbers of languages and landmarks, not from the length of texts.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc() % 4 != 2))
    ids = by_label(known.select("doc_id", "lang"), "lang", sample, 1).distinct()
    rows = known.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # some 1.1 * FULL_LABELS * sample, and one a language, at most
    place = F.xxhash64(F.lit(2), "doc_id")
    rows = common.written(rows.select("lang", F.struct(place.alias("h"), F.col("doc_id").cast("string").alias("i")).alias("at"), "text"), "sample")

    def count(batches):
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, n = letter_counts(t)
                yield pa.RecordBatch.from_arrays([pa.array([y] * len(c), pa.string()), pa.array(c, pa.int32()), pa.array(n, pa.int64())], ["lang", "c", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, c int, n bigint").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    of_letter: dict[str, dict[int, int]] = {}
    for r in counted.collect():
        of_letter.setdefault(r.lang, {})[r.c] = r.n
    codes = alphabet({y: {c: n / sum(of.values()) for c, n in sorted(of.items())} for y, of in of_letter.items()})
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    shared = spark.sparkContext.broadcast(codes)

    def sets(batches):
        for batch in batches:
            found = [grams(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["key", "grams"])

    first = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    chosen = rows.withColumn("r", first).filter(F.col("r") <= per_language(len(languages))).select(F.struct("lang", "at").alias("key"), "text")
    marks = sorted(((r.key.lang, r.key.at.h, r.key.at.i, np.array(r.grams, np.int32)) for r in chosen.mapInArrow(sets, f"key {chosen.schema['key'].dataType.simpleString()}, grams array<int>").collect()), key=lambda x: x[:3])
    land = Landmarks([x[3] for x in marks])
    landmarks = spark.sparkContext.broadcast(land)

    def kernels(batches):
        for batch in batches:
            k = np.array([landmarks.value.kernel(grams(t, shared.value)) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(k), pa.list_(pa.float64()))], ["lang", "at", "k"])

    at = rows.schema["at"].dataType.simpleString()
    every = common.written(rows.select("lang", "at", "text").mapInArrow(kernels, f"lang string, at {at}, k array<double>"), "kernels").orderBy("lang", "at")

    def blocks():
        held = []
        for r in every.toLocalIterator():
            held.append(r)
            if len(held) == 256:
                yield np.array([x.k for x in held]), [x.lang for x in held]
                held = []
        if held:
            yield np.array([x.k for x in held]), [x.lang for x in held]

    model = Model.__new__(Model).learned(codes, languages, land, counts, blocks() if marks else [])
    common.dropped(rows)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Text that is null or has no letter: `und`, score 0; equal texts have equal results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            langs, scores = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    common.prepare(docs.sparkSession)
    held = F.coalesce(crc() % 4 == 2, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
