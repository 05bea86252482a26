"""Secret scan: fixed patterns, and a battery of randomness tests on what else looks like a key.

A candidate is a whole run of 20 or more characters of A-Z a-z 0-9 + / = _ - that holds a digit and a letter, of any length. Its encoding is the
smallest alphabet that has all its characters (hex of either case, base 32, letters and digits, base 64 of either kind). Three tests measure how far it is from
characters drawn uniformly and independently from that alphabet: chi-squared for uniformity, runs above and below the alphabet's middle, serial
correlation at lag 1, each as a normal score.

The null hypothesis is that a candidate is an ordinary identifier, and a discovery is a secret. Its p-value is the chance that an ordinary identifier of the same
encoding and length looks as random: from a reference sample of made-up identifiers (words by letter frequencies, joined as names, paths and constants are,
with numbers), which for each encoding and length gives the three tests' weights and the score's mean and deviation. A Benjamini-Hochberg procedure over the document's
candidates, weighted by length over mean length (a longer run has more evidence and more to lose), keeps the share of false discoveries among a document's
`random` spans at FALSE_DISCOVERY. Runs of under LEAST_BITS bits have no power and are no candidates.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
#: What each base kind's matches must have: characters in group 2, or in all.
LEAST = {"assign": 6, "access": 20, "hex": 24}
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}")
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
FALSE_DISCOVERY, LEAST_BITS = 0.05, 60.0
#: Lengths at which reference identifiers are measured (longer runs count as the last, which only makes their p-values larger), and how many of each.
LENGTHS, REFERENCE = (20, 24, 28, 32, 40, 48, 64, 96, 128, 256), 400
#: Per mille of the letters a to z in English text, rounded; a standard table.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def tests(x: np.ndarray, k: int) -> np.ndarray:
    """For rows of characters' numbers in an alphabet of k: normal scores of chi-squared, runs and serial correlation, each about 0 for random ones."""
    m, n = x.shape
    counts = np.zeros((m, k))
    np.add.at(counts, (np.repeat(np.arange(m), n), x.ravel()), 1)
    chi = ((counts - n / k) ** 2).sum(1) * k / n
    z = ((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1)))  # Wilson and Hilferty's normal form
    above = x >= k / 2
    up = above.sum(1)
    mean = 2 * up * (n - up) / n + 1
    runs = (1 + (above[:, 1:] != above[:, :-1]).sum(1) - mean) / np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1))
    runs = np.where((up == 0) | (up == n), -math.sqrt(n), runs)
    d = x - (k - 1) / 2
    serial = (d[:, 1:] * d[:, :-1]).sum(1) / math.sqrt(n - 1) / ((k * k - 1) / 12)
    return np.column_stack([z, runs, serial])


def encoding(s: str) -> tuple[int, str] | None:
    """The number of the smallest alphabet that has all of a candidate's characters, and the candidate without its padding."""
    body = s.rstrip("=")
    have = set(body)
    i = next((i for i, a in enumerate(ALPHABETS) if have <= set(a)), None)
    return None if i is None or len(body) < 20 or len(body) * math.log2(len(ALPHABETS[i])) < LEAST_BITS else (i, body)


def identifiers(i: int, n: int, m: int, rng: np.random.Generator) -> np.ndarray:
    """m made-up ordinary identifiers of n characters in the i-th alphabet, as rows of numbers: stretches that begin with a word of one long name."""
    alphabet, letter = ALPHABETS[i], np.cumsum(np.array(LETTERS) / sum(LETTERS))
    text, begins = [], []
    at = 0
    while len(begins) < m or at < begins[m - 1] + n:
        r = rng.random(16)
        if i < 2:  # what hex holds beside keys: numbers with a few letters
            word = "".join(str(int(10 * v)) for v in r[: 3 + int(6 * r[14])]) + "".join("abcdef"[int(6 * v)] for v in r[9 : 9 + int(3 * r[15])])
        elif r[15] < 0.2:
            word = "".join(str(int(10 * v)) for v in r[: 1 + int(5 * r[14])])
        else:
            word = "".join(chr(97 + c) for c in np.minimum(np.searchsorted(letter, r[: 2 + int(9 * r[14])]), 25).tolist())
        word = word.upper() if i in (1, 2) else word.capitalize() if i == 3 and r[13] < 0.6 else word
        word += "" if i < 4 else ("/" if r[12] < 0.9 else "+") if i == 4 else "-" if r[12] < 0.5 else "_"
        begins.append(at)
        text.append(word)
        at += len(word)
    have = {c: j for j, c in enumerate(alphabet)}
    x = np.array([have.get(c, ord(c) % len(alphabet)) for c in "".join(text)])
    return x[np.array(begins[:m])[:, None] + np.arange(n)]


@functools.cache
def reference() -> np.ndarray:
    """By alphabet and length: weights of the three tests that part random runs from ordinary identifiers best (Fisher's discriminant), and the mean of
    ordinary ones so weighted, in units of their deviation."""
    rng = np.random.default_rng(3)
    out = np.empty((len(ALPHABETS), len(LENGTHS), 4))
    for i, alphabet in enumerate(ALPHABETS):
        for j, n in enumerate(LENGTHS):
            k = len(alphabet)
            plain, random = tests(identifiers(i, n, REFERENCE, rng), k), tests(rng.integers(0, k, (REFERENCE, n)), k)
            w = np.linalg.solve(np.cov(plain.T) + np.cov(random.T) + 1e-3 * np.eye(3), random.mean(0) - plain.mean(0))
            score = plain @ w
            out[i, j] = [*(w / score.std()), score.mean() / score.std()]
    return out


def p_value(s: str) -> float | None:
    """The chance that an ordinary identifier looks as random as s; None for what is no candidate."""
    found = encoding(s)
    if found is None:
        return None
    i, body = found
    at = {c: j for j, c in enumerate(ALPHABETS[i])}
    t = tests(np.array([[at[c] for c in body]]), len(at))[0]
    *w, mean = (np.interp(math.log(len(body)), np.log(LENGTHS), reference()[i, :, j]) for j in range(4))
    return math.erfc((float(t @ np.array(w)) - mean) / math.sqrt(2)) / 2


def random_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those spans that are discoveries: Benjamini and Hochberg's procedure with weights by length (see above)."""
    tested = [(a, b, p) for a, b in spans if (p := p_value(text[a:b])) is not None]
    if not tested:
        return []
    mean = sum(b - a for a, b, _ in tested) / len(tested)
    weighted = sorted((p * mean / (b - a), i) for i, (a, b, p) in enumerate(tested))
    last = max((r for r, (p, _) in enumerate(weighted, 1) if p <= FALSE_DISCOVERY * r / len(tested)), default=0)
    return sorted(tested[i][:2] for _, i in weighted[:last])


_RUN = np.zeros(256, bool)
_RUN[[*b"0123456789+/=_-", *range(65, 91), *range(97, 123)]] = True
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key", re.I)


def scan(text: str) -> list[tuple[int, int, str]]:
    """All spans of a text, base and random, by start and then kind as listed: (start, end, kind) in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), m.end(), kind) for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    maybe = [m.span() for m in CANDIDATE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    found += [(a, b, "random") for a, b in random_spans(text, maybe) if not any(x <= a and b <= y for x, y, _ in found)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _spans(text: pa.Array) -> list[list[tuple[int, int, str]]]:
    """scan() of each text. The patterns run only where the bytes hold a run of 20 such characters or one of the words: that leaves nothing out and spares most texts."""
    out: list = []
    for rows, raw, off in common.text_blocks(text):
        starts, ends, _ = common.words(raw, off, _RUN)
        hot = set((np.searchsorted(off, starts[ends - starts >= 20], "right") - 1).tolist())
        # a line end between rows, which no word holds, so that none is found across two of them
        parted, at = np.insert(raw, off[1:-1], 10).tobytes(), off + np.arange(len(off))
        hot |= set((np.searchsorted(at, [m.start() for m in _WORDS.finditer(parted)], "right") - 1).tolist())
        out += [scan(text[i].as_py() or "") if i - rows.start in hot else [] for i in range(rows.start, rows.stop)]
    return out


def scan_documents(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keep and each document's spans: array of (kind, start, end). Null text is empty and has none; rows stay as they are."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            out = [[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in _spans(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*keep, "spans"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", spans array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by [SECRET]."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at or not out:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keep, each document's text with its secrets replaced, and `n_secrets`. Null text stays null; scanned and replaced in one Python worker."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            found = _spans(text)
            clean = [redact(t, x) if x else t for t, x in zip(text.to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(clean, pa.string()), pa.array(list(map(len, found)), pa.int64())], [*keep, "text", "n_secrets"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_secrets bigint")


def digest_columns(found: DataFrame) -> DataFrame:
    """The digest of scan_documents(): counts by kind, the base spans' hash, all spans joined."""
    of = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans")
    )
