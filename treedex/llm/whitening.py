"""Whitening of embeddings: distributed centred scatter, cyclic Jacobi on the driver, one broadcast matrix.

Entries become whole numbers first, floor(256 * entry), so that sums and the scatter are integers and don't depend on the order in which partitions are
added. The scatter is taken about the rounded mean m; with y = x - m and T the sums of y, n * sum(y y') - T T' over n * n is the covariance without
a rounding error. It fits the driver by its dimensions alone: d * (d + 1) / 2 numbers, whatever the number of rows.

Jacobi rotations are symmetric and go on until every off-diagonal entry is below rounding beside its own two diagonal entries, not beside the largest,
so small eigenvalues are as accurate as large ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

#: Steps of a unit.
STEPS = 256
#: Components in the query's result.
COMPONENTS = 4
#: Rows multiplied at once. Entries under SMALL multiply and add up exactly in doubles over so many rows.
BLOCK_ROWS, SMALL = 4096, 1 << 20
EPS = float(np.finfo(float).eps)
_WIDE = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """n distinct vectors; their rounded mean m and the sums T of what is left; eigenvalues falling, eigenvectors as columns; trace of the covariance."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def matrix(self, k: int) -> np.ndarray:
        """The first k components over the root of their eigenvalue; zero for one without variance."""
        e = self.values[:k]
        real = e > EPS * len(self.values) * max(0.0, float(self.values[0]) if len(self.values) else 0.0)
        return np.where(real, self.vectors[:, :k] / np.sqrt(np.where(real, e, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) - np.asarray(self.rest, float) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 by row, exactly; None where it doesn't fit 64 bits."""
        y = x - self.mean
        most = self.n * float(np.abs(y).max(initial=0)) + max((abs(int(t)) for t in self.rest), default=0)
        if most * most * max(1, y.shape[1]) < 2.0**62:
            z = y * self.n - self.rest.astype(np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - self.rest
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(1)]


def rotations(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of d indices once, as rounds of pairs without a common index."""
    m = d + d % 2
    ring, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(a, b) for i in range(m // 2) if max(pair := (ring[i], ring[m - 1 - i])) < d for a, b in [(min(pair), max(pair))]]
        if pairs:
            out.append(tuple(np.array(x) for x in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(a: np.ndarray, sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns, largest entry positive) of a symmetric matrix by cyclic Jacobi rotations."""
    a = np.array(a, float)
    d = len(a)
    v, rounds = np.eye(d), rotations(d)
    for _ in range(sweeps):
        turned = False
        for p, q in rounds:
            off, x, y = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > EPS * np.sqrt(np.abs(x * y))
            turn &= np.abs(off) > np.finfo(float).tiny
            if not turn.any():
                continue
            turned = True
            p, q, off, x, y = p[turn], q[turn], off[turn], x[turn], y[turn]
            tau = (y - x) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            a[p, p], a[q, q] = x - t * off, y + t * off
            a[p, q] = a[q, p] = 0.0
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else v
    return np.diag(a)[order], v


def whole(column: str | Column = "embedding") -> Column:
    """The vector in whole steps; null if it is null or holds a null, a NaN or an infinity."""
    v = (F.col(column) if isinstance(column, str) else column).cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(v.isNotNull() & good, F.transform(v, lambda c: F.floor(c * F.lit(float(STEPS))).cast("bigint")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches, d: int):
    for batch in batches:
        x = _matrix(batch.column(0), d)
        for i in range(0, len(x), BLOCK_ROWS):
            yield x[i : i + BLOCK_ROWS]


def _summed(of_block, size: int):
    """A mapInArrow function: the sums by cell of what of_block gives, an integer array of that size; a row a cell, several where a sum gets long."""

    def emit(total):
        values = pa.array(total, pa.int64()).cast(_WIDE) if total.dtype == np.int64 else pa.array([Decimal(int(x)) for x in total], _WIDE)
        for i in range(0, size, 1 << 16):
            v = values.slice(i, 1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(v)), pa.int64()), v], ["cell", "v"])

    def run(batches):
        total = None
        for part in of_block(batches):
            if total is not None and (part.dtype == object or np.abs(total).max(initial=0) > 1 << 61):
                yield from emit(total)
                total = None
            if part.dtype == object:
                yield from emit(part)
            else:
                total = part if total is None else total + part
        if total is not None:
            yield from emit(total)

    return run


def _collected(distinct: DataFrame, of_block, size: int) -> np.ndarray:
    """Sums over all rows, as exact integers; `size` of them, whatever the number of rows."""
    sums = distinct.mapInArrow(_summed(of_block, size), "cell bigint, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v"))
    out = np.zeros(size, object)
    for r in sums.collect():
        out[r.cell] = int(r.v)
    return out


def _exact(y: np.ndarray) -> np.ndarray:
    """y' y for an integer matrix."""
    if np.abs(y).max(initial=0) < SMALL:
        z = y.astype(float)
        return np.rint(z.T @ z).astype(np.int64)
    z = y.astype(object)
    return z.T @ z


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From a column x (see whole; null rows take no part): each distinct vector counts once. None if there is none.

    The dimension is that of most vectors (the larger of equally many); others take no part. Exact while the scatter's sums have at most 38 digits.
    """
    rows = vectors.filter(F.col("x").isNotNull()).select("x")
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None or size.d == 0:
        return None
    d = size.d
    common.prepare(vectors.sparkSession)
    distinct = common.written(rows.filter(F.size("x") == d).distinct(), "vectors")

    def sums(batches):
        for x in _blocks(batches, d):
            small = np.abs(x).max(initial=0) < 1 << 48
            yield np.append((x if small else x.astype(object)).sum(0), len(x))

    found = _collected(distinct, sums, d + 1)
    n, s = int(found[-1]), found[:-1]
    mean = np.array([(2 * int(v) + n) // (2 * n) for v in s], np.int64)
    rest = np.array([int(v) - n * int(m) for v, m in zip(s, mean.tolist(), strict=True)], object)
    upper = np.triu_indices(d)

    def scatter(batches):
        for x in _blocks(batches, d):
            yield _exact(x - mean)[upper]

    cells = _collected(distinct, scatter, len(upper[0]))
    v = np.zeros((d, d))
    v[upper] = [float(n * int(c) - int(rest[i]) * int(rest[j])) for c, i, j in zip(cells, *(u.tolist() for u in upper), strict=True)]
    v = (v + np.triu(v, 1).T) / (float(n) * n)
    values, vectors_ = jacobi(v)
    model = Whitening(n, mean, rest, np.maximum(values, 0.0), vectors_, float(np.trace(v)))
    model.identity_error = _identity_error(distinct, model, min(components, d))
    common.dropped(distinct)
    return model


def _identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry of the whitened vectors' measured covariance minus the identity, over components with variance."""
    w = model.matrix(k)

    def run(batches):
        total, zz = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, len(w)):
            z = model.centred(x) @ w
            total, zz = total + z.sum(0), zz + z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k), pa.int64()), pa.array(np.concatenate([total, zz.ravel()]))], ["cell", "v"])

    got = np.zeros(k + k * k)
    for r in distinct.mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        got[r.cell] = r.v
    at = got[:k] / model.n
    real = np.flatnonzero(np.abs(w).any(0))
    cov = (got[k:].reshape(k, k) / model.n - np.outer(at, at))[np.ix_(real, real)]
    return float(np.abs(cov - np.eye(len(real))).max(initial=0.0))


def whiten(rows: DataFrame, model: Whitening | None, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row with a vector x of the model's dimension, for the first components.

    rows: vec_id, x. A row without x, or of another dimension, gives none. A component without variance has whitened and explained 0 and doesn't count in identity_error. deviation
    is null where it doesn't fit 64 bits. Equal vectors have equal results, whatever their ids (null too).
    """
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    d = len(model.mean)
    k = min(components, d)
    shared = rows.sparkSession.sparkContext.broadcast((model, model.matrix(k)))

    def run(batches):
        model, w = shared.value
        explained = model.values[:k] / model.trace if model.trace > 0 else np.zeros(k)
        for batch in batches:
            x = _matrix(batch.column(1), d)
            m = len(x)
            if not m:
                continue
            at = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(model.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    deviation.take(at),
                    pa.array((model.centred(x) @ w).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    common.prepare(rows.sparkSession)
    return rows.filter(F.size("x") == d).select("vec_id", "x").mapInArrow(run, schema)


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The table's vectors (vec_id, embedding) whitened by themselves."""
    rows = table.select("vec_id", whole().alias("x"))
    return whiten(rows.filter(F.col("x").isNotNull()), fit(rows, components), components)
