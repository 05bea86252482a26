"""Recall with the query's own parameters on vectors of unequal norms."""

import numpy as np
import pytest

from treedex.llm import neighbours

N, EVERY = 10_256, 160


def lengths(kind, rng):
    if kind == "lognormal":
        return np.exp(rng.normal(size=N))
    out = np.ones(N)
    if kind != "equal":
        out[7] = float(kind)
    return out


@pytest.mark.parametrize("kind", ["equal", "1.13", "2", "100", "lognormal"])
def test_recall(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(N, 64))
    x *= (lengths(kind, rng) / np.sqrt((x * x).sum(1)))[:, None]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(docs, every=EVERY).collect()}
    s = x[::EVERY] @ x.T
    s[np.arange(len(s)), np.arange(0, N, EVERY)] = -np.inf
    want = {(q * EVERY, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    recall = len(got & want) / len(want)
    print(kind, "recall", round(recall, 4))
    assert len(got) == len(want) and recall >= 0.9


def test_bands():
    assert neighbours.bands([]) == {} and neighbours.bands([0, -1]) == {0: 0, -1: 0}
    assert neighbours.bands([53, 0, -1, -8]) == {53: 0, 0: 1, -1: 1, -8: 2}
