"""Mixing against a row-by-row version with fractions: targets by resharing as defined, budgets and cuts in key order."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from treedex.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, place int, s string, deal int, range int"


def words(n, salt=0):
    return " ".join(f"w{salt}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 0, "s", 1, 2) for i, t, s in rows], SCHEMA).repartition(3)


def targets(sizes):
    """{source: target}: excess over twice a source's size is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, out = set(), {}
    while True:
        left = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        out = {s: Fraction(2 * sizes[s]) if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in order}
        above = {s for s in rest if out[s] > 2 * sizes[s]}
        if not above:
            return out
        full |= above


def brute(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    key = lambda i, t: hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    by, sizes = defaultdict(list), defaultdict(int)
    for i, t, s in rows:
        by[s].append((key(i, t), i, size(t)))
        sizes[s] += size(t)
    out = []
    for s, target in targets(sizes).items():
        budget, at = int(target), 0
        whole = budget // sizes[s] if sizes[s] else 0
        for _, i, n in sorted(by[s], key=lambda x: x[0]):
            out.append((i, s, n, sizes[s], float(target), whole * n + max(0, min(n, budget - whole * sizes[s] - at)), at))
            at += n
    return out


def same(got, want):
    k = lambda r: (str(r[0]), str(r[1]), r[2], r[6])
    got, want = sorted(map(tuple, got), key=k), sorted(want, key=k)
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want]
    assert all(abs(a[4] - b[4]) <= 1e-9 * max(1, b[4]) for a, b in zip(got, want, strict=True))


CASES = {
    "hot source": [(i, words(1 + i * 7 % 23), "big" if i % 3 else f"s{i % 13}") for i in range(400)],
    "nulls, blanks and repeats": [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "x\x0by z", None), (None, "q w", "b"), (None, "q w", "b"), (7, "one", "é"), (7, "two words", "é"), (7, "two words", "é"), (8, words(50), "\U0001f600"), (9, words(3), "￮"), (10, "\xa0\x85 w", "")],
    "no words": [(1, None, "a"), (2, " ", None)],
    "one source": [(i, words(i), "a") for i in range(9)],
    "sizes that grow by two": [(i, words(1 << i), f"s{i:02d}") for i in range(12)],
    "long text": [(1, words(200_000), "a"), (2, "x", "b"), (3, words(10), "b")],
}


@pytest.mark.parametrize("case", CASES)
def test_against_brute_force(spark, case):
    same(mixing.mix(frame(spark, CASES[case])).collect(), brute(CASES[case]))


def test_many_sources(spark):
    rng = random.Random(5)
    rows = [(i, words(rng.randrange(30)), f"s{rng.randrange(500)}") for i in range(1500)]
    got = mixing.mix(frame(spark, rows)).collect()
    same(got, brute(rows))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(frame(spark, rows).repartition(7)).collect()), key=repr)


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_other_weights(spark):
    """All sources full: each is taken as often as allowed."""
    rows = [(i, words(i + 1), f"s{i % 2}") for i in range(6)]
    assert all(r.taken == 2 * r.size and r.target == 2 * r.source_size for r in mixing.mix(frame(spark, rows), (1, 3), (2, 1)).collect())


def test_few_rounds(spark, monkeypatch):
    """Newton's steps on 10,000 sources whose sizes span twelve orders."""
    rng = random.Random(2)
    rows = [(f"s{i}", int(10 ** rng.uniform(0, 12)), (5, 2, 1)[i % 3]) for i in range(10_000)]
    sources = spark.createDataFrame(rows, "source string, source_size bigint, weight bigint")
    calls = []
    filtered = type(sources).filter
    monkeypatch.setattr(type(sources), "filter", lambda self, *a: calls.append(1) or filtered(self, *a))
    at = mixing.level(sources)
    assert len(calls) <= 12
    assert Fraction(3, 2) * sum(n for _, n, _ in rows) == sum(min(Fraction(2 * n), Fraction(w * at.above, at.below)) for _, n, w in rows)
