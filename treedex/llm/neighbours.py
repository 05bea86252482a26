"""Approximate nearest neighbours by inner product, with shifted space-filling curves.

Vectors are split into bands of norms, each at most BAND times its smallest; every query looks into every band, so that a few long vectors don't press the
others together. In a band, vectors of norm at most M get one more coordinate, sqrt(M^2 - |x|^2), and queries, scaled to norm M, a zero: the largest inner
product is then the smallest distance. Each of ORDERINGS curves rotates at random, keeps DIMS coordinates, shifts and cuts them into a grid that just holds
the band's points and queries so placed, and orders all points by their place on a Hilbert curve through it, range-partitioned by Spark; points of one cell
stand in another order on each curve. A query's candidates are the points within a window of its place on each curve; the best of all curves and bands are
merged and ranked again on the original vectors, one pair's product always summed in one order. A band of at most LEAST_WINDOW points has one curve: all are candidates.

The window is fitted: SAMPLE of the queries are compared with all points, and it is as many points as RECALL of their true neighbours need to lie in a window of
some curve, LEAST_WINDOW at least. So it grows with the table only as far as the vectors ask for: hardly for vectors in clusters, in proportion for
independent coordinates, whose neighbours no curve keeps together.

Equal vectors are one point, with its k + 1 smallest ids: a group of any size is one point on every curve, and its ids come in order.

A block of BLOCK neighbours on a curve is a task's unit; queries go to each block their window meets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from . import common, hilbert

ORDERINGS, DIMS, BITS, LEAST_WINDOW, BLOCK = 16, 10, 5, 64, 4096
#: Queries that the window is fitted on, and the share of their true neighbours that it is to hold.
SAMPLE, RECALL = 96, 0.94
#: Largest ratio of norms in a band, and the levels it is made of.
BAND, LEVELS = 1.15, 8


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors and the vectors: not null, of dim finite components, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v is not None and len(v) == dim and None not in v:
            rows.append(i)
            out.append(v)
    x = np.array(out, np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(rows, np.int64)[good], x[good] + 0.0


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1, initial=0)
    scale = np.where(most > 0, most, 1)
    return scale * np.sqrt(((x / scale[:, None]) ** 2).sum(1))


def _levels(norm: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(norm) / np.log2(BAND) * LEVELS).astype(np.int64)


def bands(levels: list[int]) -> dict[int, int]:
    """The band of each level that occurs: from the largest on, LEVELS of them at most; a gap ends none, but the next band starts at a level that occurs."""
    out, top, band = {}, None, -1
    for level in sorted(levels, reverse=True):
        if top is None or top - level >= LEVELS:
            top, band = level, band + 1
        out[level] = band
    return out


def distinct_vectors(vectors: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """h, vec (doubles), ids (k + 1 smallest), asked (some id is a query's). Each task first keeps only k + 1 ids of a vector, so no group is whole anywhere."""

    def combine(batches):
        held: dict[bytes, list] = {}

        def out():
            rows = [(h, x[0], i, x[2]) for h, x in held.items() for i in sorted(x[1])[: k + 1]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.int64(), pa.bool_()), strict=True)], ["h", "vec", "id", "asked"])

        for batch in batches:
            rows, x = _matrix(batch.column(1), dim)
            ids = batch.column(0).to_pylist()
            for r, v in zip(rows.tolist(), x, strict=True):
                if ids[r] is None:
                    continue
                raw = v.tobytes()
                h = xxhash.xxh3_128_hexdigest(raw)
                entry = held.setdefault(h, [raw, [], False])
                entry[1].append(ids[r])
                entry[2] |= ids[r] % every == 0
                if len(entry[1]) > 8 * (k + 1):
                    entry[1] = sorted(set(entry[1]))[: k + 1]
            if len(held) > 20_000:
                yield out()
                held = {}
        if held:
            yield out()

    parts = vectors.select("vec_id", "embedding").mapInArrow(combine, "h string, vec binary, id bigint, asked boolean")
    # at most k + 1 rows a vector and task; those are few, whatever the group's size
    return parts.groupBy("h").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; of those that differ from the last by rounding alone, which no order of a matrix product decides, the k smallest ids."""
    if len(s) <= k:
        return np.flatnonzero(s > -np.inf)
    last = np.partition(s, -k)[-k]
    if last == -np.inf:
        return np.flatnonzero(s > -np.inf)
    slack = 1e-13 * max(np.abs(s[s > -np.inf]).max(), 1e-300)
    tied = np.flatnonzero(np.abs(s - last) <= slack)
    if len(tied) > k:
        tied = tied[np.argsort(ids[tied], kind="stable")[:k]]
    return np.concatenate([np.flatnonzero(s > last + slack), tied])


def _window(points: DataFrame, at: DataFrame, dim: int, k: int, recall: float, sample: int) -> int:
    """How many points to each side hold so large a share of the true neighbours of some queries: of `sample` queries, whose distances to all points are computed."""
    some = points.filter("asked").select("h", "vec").orderBy(F.xxhash64("h")).limit(sample).collect()
    if not some:
        return LEAST_WINDOW
    queries, names = np.stack([np.frombuffer(r.vec) for r in some]), [r.h for r in some]

    def nearest(batches):
        for batch in batches:
            h = batch.column(0).to_pylist()
            s = queries @ np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, dim).T
            rows = [(i, h[j], float(s[i, j])) for i in range(len(names)) for j in np.argsort(-s[i], kind="stable")[: k + 1].tolist() if h[j] != names[i]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.string(), pa.float64()))], ["i", "h", "s"])

    true = points.select("h", "vec").mapInArrow(nearest, "i int, h string, s double")
    true = true.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "h"))).filter(F.col("r") <= k).select("i", "h")
    spark = points.sparkSession
    own = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, h string").join(at, "h").select("i", F.explode(F.filter("at", lambda p: p["kind"] == 1)).alias("p")).select("i", "p.o", F.col("p.rank").alias("own"))
    theirs = true.join(at, "h").select("i", "h", F.explode(F.filter("at", lambda p: p["kind"] == 0)).alias("p")).select("i", "h", "p.o", "p.rank")
    apart = theirs.join(own, ["i", "o"]).groupBy("i", "h").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("w"))
    need = np.sort([r.w for r in apart.collect()])  # sample x k numbers
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else LEAST_WINDOW


def search(vectors: DataFrame, k: int = 20, every: int = 20, orderings: int = ORDERINGS, window: int | None = None, dims: int = DIMS, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest of all other rows found.

    Nearness: largest inner product in double precision; ties go to the smaller vec_id. Rows whose id is null, or whose vector is null, zero,
    of another length than most, or holds null or non-finite components, take no part. Rows with one vec_id twice count as one. An empty table gives no row.
    window: points to each side of a query on each curve, fitted to recall if not given.
    """
    spark = vectors.sparkSession
    lengths = vectors.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = max(1, lengths.d) if lengths else 1
    points = common.written(distinct_vectors(vectors, dim, k, every), "points")
    rng = np.random.default_rng(9)
    d = min(dims, dim + 1)
    bits = min(BITS if d == DIMS else 62 // d, 20)
    turn = np.stack([np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :d] for _ in range(orderings)])
    shift = rng.random((orderings, d))

    def measure(batches):
        for batch in batches:
            norm = _norms(np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, dim))
            yield pa.RecordBatch.from_arrays([pa.array(_levels(norm)), pa.array(norm)], ["level", "norm"])

    sizes = points.select("vec").mapInArrow(measure, "level bigint, norm double").groupBy("level").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()
    band_of = bands([r.level for r in sizes])
    n_bands = max(band_of.values(), default=-1) + 1
    m, n = np.zeros(n_bands), np.zeros(n_bands, np.int64)
    for r in sizes:
        m[band_of[r.level]], n[band_of[r.level]] = max(m[band_of[r.level]], r.most), n[band_of[r.level]] + r.n
    def augmented(x, norm, band):
        """Pairs of a band and its rows' numbers and places before turning."""
        for b in np.unique(band).tolist():
            at = np.flatnonzero(band == b)
            yield b, at, np.column_stack([x[at], m[b] * np.sqrt(np.maximum(1 - (norm[at] / m[b]) ** 2, 0))])

    def parsed(column):
        x = np.frombuffer(b"".join(column.to_pylist())).reshape(-1, dim)
        norm = _norms(x)
        return x, norm, np.array([band_of[v] for v in _levels(norm).tolist()], np.int64)

    def bounds(batches):
        # the last row is for queries of norm 1
        low, high = np.full((n_bands + 1, orderings, d), np.inf), np.full((n_bands + 1, orderings, d), -np.inf)
        for batch in batches:
            x, norm, band = parsed(batch.column(0))
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            some = [(b, y) for b, _, y in augmented(x, norm, band)]
            if asked.any():
                some.append((n_bands, np.column_stack([x / norm[:, None], np.zeros(len(x))])[asked]))
            for b, y in some:
                z = np.stack([y @ t for t in turn])
                low[b], high[b] = np.minimum(low[b], z.min(1)), np.maximum(high[b], z.max(1))
        for b in np.flatnonzero(np.isfinite(low).all((1, 2))).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([low[b].ravel().tolist()]), pa.array([high[b].ravel().tolist()])], ["band", "low", "high"])

    low, high = np.full((n_bands + 1, orderings, d), np.inf), np.full((n_bands + 1, orderings, d), -np.inf)
    for r in points.select("vec", "asked").mapInArrow(bounds, "band int, low array<double>, high array<double>").collect():  # a row for each task and band
        low[r.band], high[r.band] = np.minimum(low[r.band], np.reshape(r.low, (orderings, d))), np.maximum(high[r.band], np.reshape(r.high, (orderings, d)))
    if np.isfinite(low[-1:]).all():
        low, high = np.minimum(low[:-1], m[:, None, None] * low[-1]), np.maximum(high[:-1], m[:, None, None] * high[-1])

    def place(batches):
        for batch in batches:
            h, asked = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            x, norm, band = parsed(batch.column(1))
            tie = np.array([int(v[:16], 16) for v in h.to_pylist()], np.uint64)
            unit = np.column_stack([x / norm[:, None], np.zeros(len(x))])[asked]
            some = [(0, b, at, y) for b, at, y in augmented(x, norm, band)]
            some += [(1, b, np.flatnonzero(asked), m[b] * unit) for b in range(n_bands) if len(unit)]
            for kind, b, at, y in some:
                who = h.take(pa.array(at))
                for o in range(orderings if n[b] > LEAST_WINDOW else 1):
                    c = np.clip((y @ turn[o] - low[b, o]) / np.maximum(high[b, o] - low[b, o], 1e-300), 0, 1)
                    cells = np.minimum(((c + shift[o]) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                    order = common.mix(tie[at] ^ common.mix(np.full(len(at), o + 1, np.uint64))).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), b * orderings + o, np.int32)), pa.array(hilbert.keys(cells, bits)), pa.array(order), pa.array(np.full(len(at), kind, np.int32)), who],
                        ["o", "key", "tie", "kind", "h"],
                    )

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    on_curve = points.select("h", "vec", "asked").mapInArrow(place, "o int, key bigint, tie bigint, kind int, h string").repartitionByRange(parts, "o", "key", "tie", "h").sortWithinPartitions("o", "key", "tie", "h", "kind")

    def number(batches):
        """Places count points, not queries: a band of few points meets all queries."""
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            point = (batch.column("kind").to_numpy() == 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("o", "kind", "h")), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(seen + np.cumsum(point) - point)], ["o", "kind", "h", "part", "i"])
            seen += int(point.sum())

    numbered = common.written(on_curve.mapInArrow(number, "o int, kind int, h string, part int, i bigint"), "curves")
    counts = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.sum(1 - F.col("kind")).alias("n")).collect())
    before = F.create_map(*(F.lit(int(x)) for (p, _), b in zip(counts, np.cumsum([0, *(c for _, c in counts)])[:-1], strict=True) for x in (p, b))) if counts else None
    rank = (before[F.col("part")] if counts else F.lit(0)).cast("long") + F.col("i")
    ranked = numbered.select("h", "kind", "o", rank.alias("rank"))
    at = common.written(ranked.groupBy("h").agg(F.collect_list(F.struct("kind", "o", "rank")).alias("at")), "places")  # one for each curve as a query, one for each of its band's as a point
    common.dropped(numbered)
    width = max(LEAST_WINDOW, window if window is not None else _window(points, at, dim, k, recall, sample))
    reach = F.when(F.col("p.kind") == 1, F.lit(width)).otherwise(0)
    least = F.floor((F.col("p.rank") - reach) / BLOCK)
    last = F.floor((F.col("p.rank") + reach) / BLOCK)
    dealt = (
        points.select("h", "vec", F.col("ids")[0].alias("id")).join(at, "h").select("h", "vec", "id", F.explode("at").alias("p"))
        .select("h", "vec", "id", "p.kind", "p.rank", "p.o", F.explode(F.sequence(least, last)).alias("block")).select(F.xxhash64("o", "block").alias("cell"), "kind", "rank", "h", "vec", "id", "o")
    )

    def score(batches):
        cell, data = None, []
        ready = None
        for batch in batches:
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])]))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(cells)], strict=True):
                part = [batch.column(c).slice(a, b - a) for c in range(2, 6)]
                ranks, x, ids = part[0].to_numpy(), np.frombuffer(b"".join(part[2].to_pylist())).reshape(-1, dim), part[3].to_numpy()
                if kinds[a] == 0:
                    if cell != cells[a]:
                        cell, data = cells[a], []
                    data.append((ranks, x, ids, part[1].to_pylist()))
                    ready = None
                elif cell == cells[a]:
                    if ready is None:
                        ready = [np.concatenate([p[c] for p in data]) for c in range(3)] + [[h for p in data for h in p[3]]]
                    s = x @ ready[1].T
                    s[np.abs(ranks[:, None] - ready[0][None, :]) > width] = -np.inf
                    rows = []
                    for i, h in enumerate(part[1].to_pylist()):
                        near = _best(s[i], ready[2], k + 1)
                        rows += [(h, ready[3][j], float(s[i, j]), int(ready[2][j])) for j in near.tolist() if s[i, j] > -np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))], ["q", "h", "score", "id"])

    # cells are few for the partitions there may be; a hash of each cell deals them
    near = dealt.repartition(F.col("cell")).sortWithinPartitions("cell", "kind").mapInArrow(score, "q string, h string, score double, id bigint")
    best = near.groupBy("q", "h").agg(F.max("score").alias("score"), F.min("id").alias("id")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= 2 * (k + 1))
    pair = best.select("q", "h").join(points.select("h", "vec", "ids"), "h").join(points.select(F.col("h").alias("q"), F.col("vec").alias("own")), "q").select("q", "own", "vec", "ids")

    def exact(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist())).reshape(-1, dim) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array((x * y).sum(1))], ["q", "ids", "score"])

    again = pair.mapInArrow(exact, "q string, ids array<bigint>, score double")
    listed = again.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = common.written(listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "nearest")

    def queries(batches):
        for batch in batches:
            rows, x = _matrix(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([xxhash.xxh3_128_hexdigest(v.tobytes()) for v in x], pa.string())], ["query_id", "q"])

    asked = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(queries, "query_id bigint, q string").distinct()
    own = asked.join(lists, "q").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("i", "x"))
    return own.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
