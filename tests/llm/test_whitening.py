"""Whitening against numpy on whole numbers, Jacobi on badly scaled matrices, and the edges."""

import math
from fractions import Fraction

import numpy as np
import pytest

from treedex.llm import common, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, n int, component string"


def rows_of(v, first=0):
    return [(first + i, None if x is None else [None if c is None else float(c) for c in x], "x", 1, "c") for i, x in enumerate(v)]


def brute(table, k=4):
    """By exact fractions and numpy's eigenvalues: (n, {vec_id: (deviation, centred)}, eigenvalues, eigenvectors)."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, *_ in table if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in good})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = [[float(Fraction(sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit), n**3)) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(cov))
    order = np.argsort(-e)
    return n, {i: (sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)), np.array([c - t / n for c, t in zip(v, s, strict=True)])) for i, v in good}, e[order], u[:, order]


def held(got, table, k=4):
    n, each, e, u = brute(table)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(each)
    signs = {}
    for i, rs in by.items():
        rs = sorted(rs, key=lambda r: r.component)
        assert [r.component for r in rs] == list(range(1, min(k, len(e)) + 1))
        for r in rs:
            c = r.component - 1
            want = each[i][1] @ u[:, c] / math.sqrt(e[c])
            if c not in signs and abs(want) > 1e-3:
                signs[c] = 1 if want * r.whitened > 0 else -1
            assert (r.n, r.deviation) == (n, each[i][0])
            assert abs(r.whitened * signs.get(c, 1) - want) < 1e-9
            assert abs(r.explained - e[c] / e.sum()) < 1e-12 and r.identity_error < 1e-9


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = (rng.standard_normal((400, 7)) * [3, 1, 0.5, 0.2, 0.1, 2, 1]).tolist()
    hot = [v[0]] * 300  # a vector that many rows share counts once
    table = rows_of([*v, *hot, None, [None] * 7, [float("nan")] * 7, [math.inf, 0, 0, 0, 0, 0, 0], [-0.0] * 7])
    held(whitening.whitened(spark.createDataFrame(table, SCHEMA).repartition(5)).collect(), table)


def test_small_and_repeated(spark):
    table = rows_of([[1.0, 2.0], [1.0, 2.0], [0.5, -1.0], [3.0, 0.25]])
    held(whitening.whitened(spark.createDataFrame(table, SCHEMA)).collect(), table)


def test_no_variance(spark):
    got = whitening.whitened(spark.createDataFrame(rows_of([[1.0, 2.0]] * 3), SCHEMA)).collect()
    assert len(got) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0, 0, 0) for r in got)


def test_a_direction_without_variance(spark):
    got = whitening.whitened(spark.createDataFrame(rows_of([[float(i), 2.0 * i] for i in range(5)]), SCHEMA)).collect()
    assert all(r.whitened == 0 for r in got if r.component == 2) and max(r.identity_error for r in got) < 1e-12


@pytest.mark.parametrize("v", [[], [None, None], [[]], [[None]]])
def test_nothing_to_fit(spark, v):
    got = whitening.whitened(spark.createDataFrame(rows_of(v), SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0


def test_other_dimensions_take_no_part(spark):
    table = rows_of([[1.0, 2.0], [2.0, 2.5], [0.0, 9.0]])
    held(whitening.whitened(spark.createDataFrame([*table, *rows_of([[1.0], [1.0, 2.0, 3.0]], 10)], SCHEMA)).collect(), table)


def test_large_entries(spark):
    """Beyond what a double or 64 bits hold exactly."""
    v = [[2.0**40 + 3 * i * i, -(2.0**36) * i] for i in range(6)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    whole = [[math.floor(256 * c) for c in x] for x in v]
    s = [sum(c) for c in zip(*whole, strict=True)]
    for r in whitening.whitened(frame).collect():
        exact = sum((6 * c - t) ** 2 for c, t in zip(whole[r.vec_id], s, strict=True))
        assert r.deviation == (exact if exact < 1 << 63 else None) and r.identity_error < 1e-6


@pytest.mark.parametrize("d", [0, 1, 2, 5, 8, 33])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d))) if d else (np.zeros((0, 0)), 0)
    want = np.sort(rng.random(d))[::-1] + 0.1
    e, v = whitening.jacobi((q * want) @ q.T)
    assert np.allclose(e, want, atol=1e-13) and np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose((v * e) @ v.T, (q * want) @ q.T, atol=1e-13)


def test_jacobi_small_eigenvalues():
    """Of a matrix scaled over 24 orders: relative accuracy of each, where one that is accurate beside the largest alone has lost the small ones."""
    rng = np.random.default_rng(1)
    b = np.eye(6) + 0.1 * rng.standard_normal((6, 6))
    scale = 10.0 ** -np.arange(0, 12, 2)
    a = scale[:, None] * (b @ b.T) * scale[None, :]
    e, _ = whitening.jacobi(a)
    inverse, _ = whitening.jacobi(np.linalg.inv(b @ b.T) / scale[:, None] / scale[None, :])
    assert np.allclose(e * inverse[::-1], 1, rtol=1e-10) and e[0] / e[-1] > 1e15


def test_rounds_have_each_pair_once():
    for d in range(2, 9):
        pairs = [(a, b) for p, q in whitening.rotations(d) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
        assert sorted(pairs) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    held(queries.op11_whitening(spark, d).collect(), [tuple(r) for r in common.table(spark, d, "embeddings").select("vec_id", "embedding").collect()])
