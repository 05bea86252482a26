"""The audit of sources against a version with dictionaries, and its edges."""

import re
from collections import Counter, defaultdict

import pytest

from treedex.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n bigint, term string, p string, deal int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, "t", "p", 1) for i, (t, x, s) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, least):
    docs, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for t, x, s in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t or "")]
        docs[x or ""].update(set(terms))
        counts[x or "", s or ""].update(terms)
    for x in {x for x, _ in counts}:
        kept = [t for t, n in docs[x].items() if n >= least]
        sources = [s for y, s in counts if y == x]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((counts[x, s] for s in sources), Counter()))
        p = {s: shares(counts[x, s]) for s in sources}
        for s in sources:
            pair = [(b, sum(abs(p[s][t] - p[b][t]) for t in kept)) for b in sources if b != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[x, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pair, None), ("term", term, 50)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda r: (-r[1], r[0].encode()))[:top], 1):
                    out.append((x, s, part, item, value, rank))
    return sorted(out)


MIXED = [(f"the {w} of {w}{i % 4} And É{i % 3}" + " a-b_c" * (i % 5), ("en", "de", None)[i % 3], f"s{i % 7}" if i % 11 else None) for i in range(300) for w in ("cat", "Dog")]
CASES = {
    "mixed": (MIXED, 30),
    "nulls and empty": ([*MIXED, (None, "xx", "a"), ("", "xx", "b"), ("12 3!", "xx", None), (None, None, None)], 30),
    "no kept term": ([("a b", "en", "s1"), ("a c", "en", "s2"), ("d", "en", "s3")], 30),
    "a source without terms": ([*[("w x y", "en", "s1")] * 3, (None, "en", "s2")], 2),
    "hot source": ([("hot words here " + str(i % 2) * 3 + "x" * (i % 60), "en", "hot" if i % 50 else f"s{i}") for i in range(500)], 5),
    "ties": ([(" ".join(f"t{c}" for c in "abcdefghijklmnopqrstuvwxyzé\U0001f600￮"), "en", s) for s in ("a", "b")] * 3 + [("only", "en", "b")] * 2, 2),
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    rows, least = CASES[case]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), least).collect())) == brute(rows, least)


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_long_text(spark):
    """A text of several pieces counts once in documents."""
    long = "Word " * 400_000 + "é" * 3_000_000 + " tail"
    assert {k.decode(): v for k, v in divergence.term_counts(long.encode()).items()} == {"word": 400_000, "é" * 3_000_000: 1, "tail": 1}
    rows = [("Word " * 300_000, "en", "a"), ("word tail", "en", "b"), ("tail", "en", "b")]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows), 2).collect())) == brute(rows, 2)


def test_counts_handed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(["a", "b", "a", "a"]), pa.array([b"x y z x", b"x", b"x w", b""])], ["lang", "source", "text"])
    total = Counter()
    for out in divergence._count([batch, batch]):
        for r in out.to_pylist():
            total[r["source"], r["term"], "n"] += r["n"]
            total[r["source"], r["term"], "docs"] += r["docs"]
    assert total["a", "x", "n"] == 6 and total["a", "x", "docs"] == 4 and total["b", "x", "docs"] == 2 and total["a", "w", "n"] == 2
