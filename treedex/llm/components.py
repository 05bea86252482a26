"""Connected components of a graph of 64-bit nodes, by alternating large and small stars over an edge table.

Each step is a minimum by node and a join; the minima are a written table, so that a node with a large share of all edges is split by
adaptive execution. The loop ends when a round changes nothing; its edges are then (node, smallest node of the component).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b with a > b. Each node's neighbours are tied to the smallest of them: larger ones, or smaller ones and itself. Written, as the next edges."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = common.written(both.groupBy("a").agg(F.min("b").alias("m")), "least")
    # large: for (u, v) with v > u, v meets min(u and its neighbours); small: for (u, v) with v < u, v and u meet min of the smaller ones
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    done = common.written(out.filter("a <> b").distinct(), "large" if large else "small")
    common.dropped(least)
    return done


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint, any order, repeats and loops allowed). Returns written (a, b): node and the smallest of its component, for all but that one."""
    now = common.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        mid = _star(now, True)
        common.dropped(now)
        now = _star(mid, False)
        common.dropped(mid)
        # min and sum of hashes: the same twice over means that nothing moved
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (r.n, r.h) or r.n == 0:
            return now
        mark = r.n, r.h
