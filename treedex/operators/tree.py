"""Trees as intervals: a node's subtree is the nodes of its file whose `pre` lies between its `pre` and `last`.

Questions about what lies above or below a node are running sums and running maxima in the order of `pre`, one sort by file each, so that a file's cost
grows with its nodes and not with their pairs. No window frame runs from a row to the end, which Spark would compute anew for each row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def _before(by: list[str], order: Column):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def intervals(nodes: DataFrame, file: str = "file_path", order: str = "pre", level: str = "level", levels: int | list[int] = 6) -> DataFrame:
    """Adds parent_pre (nearest earlier node of a smaller level) and last, from order and level alone. One shuffle and two sorts by file.

    levels: those that occur, or their number from 1 on. For each the latest earlier node (and the first later one) is known by a running maximum; the
    parent is the greatest of those of smaller levels. For more levels than can be written out, see nested().
    """
    lvl, at = F.col(level), F.col(order)
    all_ = list(range(1, levels + 1)) if isinstance(levels, int) else sorted(levels)
    up, down = _before([file], at.asc()), _before([file], at.desc())
    pick = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    parent, stop = F.lit(None).cast("bigint"), F.lit(None).cast("bigint")
    seen = [F.max(F.when(lvl == k, at)).over(up) for k in all_]
    nexts = [F.min(F.when(lvl == k, at)).over(down) for k in all_]
    for i, k in enumerate(all_):
        parent = F.when(lvl == k, pick(F.greatest, seen[:i])).otherwise(parent) if i else parent
        stop = F.when(lvl == k, pick(F.least, nexts[: i + 1])).otherwise(stop)
    end = F.first(at).over(Window.partitionBy(file).orderBy(at.desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return nodes.withColumns({"parent_pre": parent.cast("bigint"), "last": F.coalesce(stop - 1, end).cast("bigint")})


def nested(nodes: DataFrame, file: str = "file_path", order: str = "pre", level: str = "level") -> DataFrame:
    """As intervals(), for any number of levels: two passes over batches sorted by file, one from each end, with a stack as deep as the tree."""

    def run(forward: bool):
        def batches_(batches):
            now, stack, first = None, [], 0
            for batch in batches:
                out = []
                for f, p, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if f != now:
                        now, stack, first = f, [], p
                    # forward: the nearest earlier node of a smaller level; backward: the nearest later one of the same or a smaller
                    while stack and (stack[-1][0] >= v if forward else stack[-1][0] > v):
                        stack.pop()
                    out.append((stack[-1][1] if stack else None) if forward else (stack[-1][1] - 1 if stack else first))
                    stack.append((v, p))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "parent_pre" if forward else "last"])

        return batches_

    slim = nodes.select(F.col(file).alias("_f"), F.col(order).cast("bigint").alias("_p"), F.col(level).cast("bigint").alias("_l"))
    kind = slim.schema["_f"].dataType.simpleString()
    head = f"_f {kind}, _p bigint, _l bigint"
    up = slim.repartition("_f").sortWithinPartitions("_f", "_p").mapInArrow(run(True), f"{head}, parent_pre bigint")
    both = up.sortWithinPartitions("_f", F.desc("_p")).mapInArrow(run(False), f"{head}, parent_pre bigint, last bigint")
    return nodes.join(both.select(F.col("_f").alias(file), F.col("_p").alias(order), "parent_pre", "last"), [file, order])


def covered(rows: DataFrame, weight: Column, by: list[str] = ["file_path"], pre: str = "pre", last: str = "last") -> DataFrame:  # noqa: B006
    """Adds `cover`: the sum of weights of the rows at or above each in the tree. A running sum: a row's weight comes at its pre and goes after its last."""
    row, w = F.struct(*rows.columns), F.coalesce(weight, F.lit(0)).cast("bigint")
    typed = f"struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.schema.fields)}>"
    event = lambda at, kind, d, r: F.struct(at.cast("bigint").alias("at"), F.lit(kind).alias("kind"), d.alias("d"), r.alias("r"))
    events = F.when(w == 0, F.array(event(F.col(pre), 1, w, row))).otherwise(F.array(event(F.col(pre), 1, w, row), event(F.col(last) + 1, 0, -w, F.lit(None).cast(typed))))
    e = rows.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(by)), F.explode(events).alias("e"))
    order = Window.partitionBy(*(f"_{i}" for i in range(len(by)))).orderBy("e.at", "e.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("cover", F.sum("e.d").over(order)).filter("e.kind = 1").select("e.r.*", "cover")


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """file_path, pre, n of nodes that have descendants. Parsers number a file's nodes without gaps, so the interval's length is the count."""
    return nodes.select("file_path", "pre", (F.col("last") - F.col("pre")).alias("n")).filter("n > 0")


def descendants(nodes: DataFrame, above: Column) -> DataFrame:
    """Nodes strictly below any node for which `above` holds, each once."""
    marked = covered(nodes.withColumn("_own", F.coalesce(above, F.lit(False)).cast("bigint")), F.col("_own"))
    return marked.filter("cover > _own").drop("_own", "cover")


def children(nodes: DataFrame, parent: Column, node_type: str | None = None) -> DataFrame:
    out = nodes.filter(F.col("parent_pre") == parent)
    return out.filter(F.col("node_type") == node_type) if node_type else out


def depth_and_path(nodes: DataFrame, text: str = "text", levels: int | list[int] = 6, level: str = "level") -> DataFrame:
    """file_path, pre, depth (1 at a root) and path: texts from the root down to the node, ids where a text is empty.

    levels: as in intervals(). The latest node of a smaller level is above a node if no node of a still smaller one stands between.
    """
    all_ = list(range(1, levels + 1)) if isinstance(levels, int) else sorted(levels)
    name = F.coalesce(F.nullif(F.col(text), F.lit("")), F.col("pre").cast("string"))
    up = _before(["file_path"], F.col("pre").asc())
    n = nodes.select("file_path", "pre", F.col(level).alias("_l"), name.alias("_n"))
    n = n.withColumns({f"_s{k}": F.max(F.when(F.col("_l") == k, F.struct("pre", "_n"))).over(up) for k in all_[:-1]})
    above, top = [], F.lit(-1).cast("bigint")
    for k in all_[:-1]:
        s = F.col(f"_s{k}")
        above.append(F.when((F.col("_l") > k) & (s["pre"] > top), s["_n"]))
        top = F.greatest(top, F.coalesce(s["pre"].cast("bigint"), F.lit(-1)))
    path = F.filter(F.array(*above, F.col("_n")), lambda x: x.isNotNull())
    return n.select("file_path", "pre", path.alias("path")).select("file_path", "pre", F.size("path").cast("bigint").alias("depth"), "path")


def nearest_heading(nodes: DataFrame, hits: DataFrame, levels: int | list[int] = 6, level: str = "level") -> DataFrame:
    """hits (file_path, pre) with the nearest heading at or above each, as heading_pre and heading_text; hits without one are left out.

    levels: those of headings. Of each the latest at or before a node is the only one of its level that can hold it.
    """
    head, order = F.col("node_type") == "heading", Window.partitionBy("file_path").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = list(range(1, levels + 1)) if isinstance(levels, int) else sorted(levels)
    seen = [F.max(F.when(head & (F.col(level) == k), F.struct("pre", "last", "text"))).over(order) for k in all_]
    n = nodes.select("file_path", "pre", *(s.alias(f"_s{k}") for k, s in zip(all_, seen, strict=True)))
    held = [F.when(F.col(f"_s{k}.last") >= F.col("pre"), F.col(f"_s{k}")) for k in all_]
    n = n.select("file_path", "pre", (F.greatest(*held) if len(held) > 1 else held[0]).alias("h")).filter("h is not null")
    return hits.join(n, ["file_path", "pre"]).select(*hits.columns, F.col("h.pre").alias("heading_pre"), F.col("h.text").alias("heading_text"))
