"""Repeated windows of one lane and whole tables against counting all windows: twins, neighbours, many phases, long texts, ids of other types and none."""

import hashlib
import random
from collections import Counter

import numpy as np

from treedex.llm import common, repeats
from treedex.llm.suffix_array import suffix_arrays


def test_many_arrays():
    rng = np.random.default_rng(2)
    for turn in range(60):
        texts = [np.append(np.tile(rng.integers(1, 3, rng.integers(1, 5)), rng.integers(1, 15)) if turn % 3 == 0 else rng.integers(1, rng.integers(2, 6), rng.integers(0, 70)), 0) for _ in range(rng.integers(1, 14))]
        off = np.cumsum([0, *map(len, texts)])
        got = suffix_arrays(np.concatenate(texts), off)
        for i, t in enumerate(texts):
            assert (got[off[i] : off[i + 1]] - off[i]).tolist() == sorted(range(len(t)), key=lambda x: t[x:].tolist())


def test_windows_of_lanes():
    """Bodies that share an anchor, as kinds of one gram do, over few letters so that much almost repeats."""
    rng = random.Random(3)
    for _ in range(25):
        bodies, anchors, twice, lanes = [], [], [], []
        for lane in range(rng.randint(1, 5)):
            core = bytes(rng.choice(b"ab") for _ in range(420))
            for _ in range(rng.randint(1, 6)):
                x, y = rng.randint(0, 150), rng.randint(0, 150)
                body = bytearray(core[x : 420 - y])
                for _ in range(rng.choice([0, 0, 1, 2])):
                    body[rng.randrange(len(body))] = rng.choice(b"abc")
                if len(body) >= 200:
                    bodies.append(bytes(body))
                    anchors.append(200 - x)
                    twice.append(rng.random() < 0.2)
                    lanes.append(lane)
        if not bodies:
            continue
        got = set(zip(*(v.tolist() for v in repeats.repeated_windows(np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)]), np.array(anchors), np.array(twice), np.array(lanes))), strict=True))
        seen = Counter()
        for b, a, t, lane in zip(bodies, anchors, twice, lanes, strict=True):
            for p in range(len(b) - 199):
                seen[lane, (a - p) % repeats.WORD, b[p : p + 200]] += 1 + t
        want = {(i, p) for i, (b, a, lane) in enumerate(zip(bodies, anchors, lanes, strict=True)) for p in range(len(b) - 199) if seen[lane, (a - p) % repeats.WORD, b[p : p + 200]] > 1}
        assert got == want


def removed(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        c = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 199):
            if n[b[i : i + 200]] > 1:
                c[i] += 1
                c[i + 200 if i + 200 <= len(b) else len(b)] -= 1
        gone = np.cumsum(c)[:-1] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def test_long_texts_and_other_ids(spark):
    common.prepare(spark)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst ") for _ in range(n))
    passage, other = word(700), word(205)
    far = word(repeats.PIECE - 300) + passage + word(400_000) + other  # the passage lies across the cut of a long text
    texts = [far, word(100) + passage[100:450] + word(30), other, word(150) + other[1:] + "x", None, "", passage, passage, "é" * 120, "é" * 120 + "z"]
    ids = ["a", None, None, "b", "c", None, "d", "d", "e", ""]
    got = repeats.repeats(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id string, text string"))
    key = lambda r: (r[0] or "", *r[1:])
    assert sorted(map(key, map(tuple, got.drop("text_kept").collect()))) == sorted(map(key, ((i, *r) for i, r in zip(ids, removed(texts), strict=True))))
    assert repeats.repeats(spark.createDataFrame([("a", passage)], "doc_id string, text string"), text=False).first().n_removed == 0
