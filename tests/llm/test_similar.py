"""Wide fingerprints word by word, their cells' recall on copies with changed words, and edge cases."""

import random

import numpy as np

from treedex.llm import common, simhash


def fingerprint(text):
    """One row: its words' hashes as the library takes them, all else bit by bit."""
    raw = common.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = common.words(raw, np.array([0, len(raw)]), simhash.IS_WORD)
    w = [int(x) for x in common.span_hash(common.prefix_hash(raw), starts, ends)]
    if not w:
        return [0] * simhash.WIDE
    size, all_ones = min(5, len(w)), (1 << 64) - 1
    hashes = set()
    for i in range(len(w) - size + 1):
        h = size
        for x in w[i : i + size]:
            h = (h * 0x9DDFEA08EB382D69 + x) & all_ones
        hashes.add(int(common.mix(np.array([h], np.uint64))[0]))
    out = []
    for j in range(simhash.WIDE):
        own = [int(common.mix(np.array([(h + 0x9E3779B97F4A7C15 * (j + 1)) & all_ones], np.uint64))[0]) for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return out


def test_fingerprints():
    rng = random.Random(2)
    texts = ["", " \t", "one", "a b c d", "a b c d e", "A B  c\nd e", "x y " * 700, *(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    raw = [t.encode() for t in texts]
    got = simhash.wide_fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [[int(x) for x in r] for r in got] == [fingerprint(t) for t in texts]


def test_recall_and_groups(spark):
    common.prepare(spark)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(200, 600))]
        v = list(w)
        for j in rng.sample(range(len(v)), round(len(v) * rng.uniform(0.0, 0.02))):
            v[j] = rng.choice(vocabulary)
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
        pairs.append((2 * i, 2 * i + 1, len(a & b) / len(a | b)))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    rows += [(None, "null id text"), (None, None), (1000, ""), (1001, None), (1002, "null id text")]
    got = {}
    for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.component_id)
    near = [(a, b) for a, b, s in pairs if s >= 0.8]
    assert len(near) > 100 and sum(got[b] == got[a] == [a] for a, b in near) >= 0.95 * len(near)
    assert got[1000] == got[1001] == [1000] and got[1002] == [1002] and sorted(got[None]) == [1000, 1002]
    assert simhash.similar(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_forest():
    """Kruskal's on the same order of links: the sums agree, and every component is spanned."""
    rng = np.random.default_rng(3)
    for n, m in ((2, 1), (30, 20), (60, 400)):
        left, right = rng.integers(0, n, m), rng.integers(0, n, m)
        left, right = left[left != right], right[left != right]
        weight, name = rng.integers(0, 5, len(left)), rng.permutation(n)
        i, j = simhash.forest(left, right, weight, name)
        above = list(range(n))

        def top(x, above=above):
            while above[x] != x:
                x = above[x]
            return x

        want = set()
        for w, _, _, a, b in sorted((int(w), min(name[a], name[b]), max(name[a], name[b]), int(a), int(b)) for a, b, w in zip(left, right, weight, strict=True)):
            if top(a) != top(b):
                above[top(a)] = top(b)
                want.add((a, b))
        assert {frozenset(x) for x in want} == {frozenset(x) for x in zip(i.tolist(), j.tolist(), strict=True)} and len(i) == len(want)


def test_sets_decide(spark):
    """Clusters about the threshold, where many near fingerprints aren't alike: groups are those of all pairs that share a cell, are near and are alike."""
    common.prepare(spark)
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 260))]
        for _ in range(14):
            v = list(base)
            for j in rng.sample(range(len(v)), round(len(v) * rng.uniform(0.0, 0.035))):
                v[j] = f"w{rng.randrange(4000)}"
            texts.append(" ".join(v))
    texts += texts[:20] + ["", "  "]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    raw = [t.encode() for t in texts]
    fp = simhash.wide_fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    cells, sets = simhash.cell_keys(fp), [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    label, refused, radius = np.arange(len(texts)), 0, simhash.wide_radius()
    links = []
    for a in range(len(texts)):
        for b in range(a):
            if simhash.distance(fp[a][None], fp[b][None])[0] <= radius and (cells[:, a] == cells[:, b]).any():
                alike = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
                refused += not alike
                if alike:
                    links.append((a, b))
    for _ in range(len(texts)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert refused > 100 and len(links) > 100 and [got[i] for i in range(len(texts))] == label.tolist()
