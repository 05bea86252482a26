"""The fitted window: small for vectors in clusters, with recall all the same; and ranks of different vectors with equal products."""

import numpy as np

from treedex.llm import neighbours


def test_clusters(spark, monkeypatch):
    rng, seen, fit = np.random.default_rng(4), [], neighbours._window
    monkeypatch.setattr(neighbours, "_window", lambda *a: seen.append(fit(*a)) or seen[-1])
    n, every = 12_000, 200
    centres = rng.normal(size=(150, 64))
    x = centres[rng.integers(0, 150, n)] + 0.25 * rng.normal(size=(n, 64))
    docs = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in neighbours.search(docs, every=every).collect()}
    s = x[::every] @ x.T
    s[np.arange(len(s)), np.arange(0, n, every)] = -np.inf
    want = {(q * every, int(i)) for q, row in enumerate(s) for i in np.argsort(-row)[:20]}
    recall = len(got & want) / len(want)
    share = neighbours.ORDERINGS * (2 * seen[0] + 1) / n
    print("clusters: recall", round(recall, 4), "window", seen[0], "share at most", round(share, 3))
    assert recall >= 0.9 and share < 0.5


def test_ties_of_different_vectors(spark):
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 3, (400, 6)), axis=0)
    x = rng.permutation(x[(x != 0).any(1)])[:300]
    got = neighbours.search(spark.createDataFrame(list(enumerate(x.astype(float).tolist())), "vec_id bigint, embedding array<double>"), window=400)
    found: dict = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for q in range(0, len(x), 20):
        s = x @ x[q]
        want = [(i, float(s[i])) for i in sorted((j for j in range(len(x)) if j != q), key=lambda j: (-s[j], j))[:20]]
        assert found[q] == want, q
