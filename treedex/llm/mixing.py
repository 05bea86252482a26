"""Mixing sources to target weights by words.

Every document gets a random key, a hash of its id and text. Within its source documents stand in the order of their keys, a running sum of their words
says where each begins, and the source is cut at exactly its budget. A budget beyond the source's size repeats it: whole epochs first, then the cut.

Keys are spread evenly, so ranges of them are cells of about equal size that need no sampling: a document's cell follows from its key. Words are summed by
cell first, cells' sums give each cell's beginning, and a running sum within each cell does the rest. So a hot source is as many tasks as it has cells. Texts
are read once; ids, keys and sizes alone are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Weights of the sources in order, repeating; words of the mix as parts of all words; most times that a source is taken.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
EPOCHS = 2
#: Documents in a cell, at most about.
CELL_ROWS = 1 << 18
#: Digits of the key that are read as a number: 60 bits.
KEY_DIGITS = 15
_D = "decimal(38,0)"


def size(text: str | Column = "text") -> Column:
    """Number of words in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Hexadecimal digits that follow from id and text alone, so that reruns agree; null is empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(part(doc_id), F.lit(":"), F.md5(part(text).cast("binary"))).cast("binary"))


def numbered(names: DataFrame, column: str) -> DataFrame:
    """names with `place`, from 0 in ascending order of a column of distinct values, null last: ranges of names are counted first, so no task has them all."""
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(column).asc_nulls_last()
    dealt = common.written(names.repartitionByRange(n, order).withColumn("range", F.spark_partition_id()), "names")
    counts = {r.range: r["count"] for r in dealt.groupBy("range").count().collect()}  # a row a range
    before, at = [], 0
    for r in range(max(counts, default=-1) + 1):
        before.append(at)
        at += counts.get(r, 0)
    begin = F.array(*map(F.lit, before))[F.col("range")] if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return dealt.withColumn("place", (begin + inside).cast("bigint")).drop("range")


def _exact(x: int, digits: int) -> Column:
    return F.lit(str(x)).cast(f"decimal({digits},0)")


@dataclass
class Level:
    """A source of weight w takes the lesser of EPOCHS times its size and w * (above / below) words."""

    above: int
    below: int


def level(sources: DataFrame, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> Level:
    """The level at which sources (source_size, weight) take their share of all words: excess over a source's bound goes to the others by weight, until none is above.

    Each round is one sum over the sources. The words taken are a concave function of the level made of straight pieces, and a round is a Newton step on it from below: few
    rounds do, whatever the number of sources (the error times the weight still open falls to a quarter or less each time).
    """
    total, weight = sources.agg(F.sum(F.col("source_size").cast(_D)), F.sum(F.col("weight").cast(_D))).first()
    budget = share[0] * int(total or 0)
    now = Level(budget, share[1] * int(weight or 0))
    while now.below:
        bound = F.col("source_size").cast("decimal(20,0)") * epochs
        full = bound * _exact(now.below, 18) <= F.col("weight").cast("decimal(10,0)") * _exact(now.above, 27)
        taken, gone = sources.filter(full).agg(F.sum(bound.cast(_D)), F.sum(F.col("weight").cast(_D))).first()
        new = Level(budget - share[1] * int(taken or 0), share[1] * (int(weight) - int(gone or 0)))
        if new.below in (0, now.below):  # all are full, or no other than before
            break
        now = new
    return now


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n_rows, weight, target, budget (whole words) of each source of rows (source, size)."""
    found = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    weight = F.array(*map(F.lit, weights))[F.pmod(F.col("place"), F.lit(len(weights))).cast("int")]
    sources = common.written(numbered(found, "source").withColumn("weight", weight.cast("bigint")).drop("place"), "sources")
    at = level(sources, share, epochs)
    bound = F.col("source_size").cast("decimal(20,0)") * epochs
    w = F.col("weight").cast("decimal(10,0)")
    open_ = bound * _exact(at.below, 18) > w * _exact(at.above, 27)
    target = F.when(open_, F.col("weight").cast("double") * F.lit(float(at.above)) / F.lit(float(max(1, at.below)))).otherwise(bound.cast("double"))
    whole = F.when(open_, F.expr(f"(CAST(weight AS decimal(10,0)) * CAST('{at.above}' AS decimal(27,0))) DIV CAST('{max(1, at.below)}' AS decimal(18,0))")).otherwise(bound.cast("bigint"))
    return sources.select("source", "source_size", "n_rows", "weight", target.alias("target"), whole.cast("bigint").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, place of every document.

    place: words before the document in its source's order. taken: its words that the mix takes: size times the whole epochs, and what of it lies before the cut in the last one.
    A source's taken words sum to its target, rounded down. Null text and texts of blanks have size 0 and take 0; a null source is a source, the last. Documents with one id and one
    text are interchangeable, others with one id have keys of their own. An empty table gives no row. Other columns aren't read.
    """
    spark = docs.sparkSession
    rows = common.written(docs.select("doc_id", "source", size().alias("size"), key().alias("key")), "sizes")
    sources = common.written(plan(rows, weights, share, epochs), "targets")
    n_rows = sources.agg(F.sum("n_rows")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, min(CELL_ROWS, n_rows // (4 * parts)))
    cells = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / each))
    number = F.conv(F.substring("key", 1, KEY_DIGITS), 16, 10).cast("bigint") / F.lit(float(16**KEY_DIGITS))
    joined = common.with_group(rows, sources, "source", "n_rows", F.xxhash64("key"))
    placed = joined.select("doc_id", "source", "size", "key", "source_size", "target", "budget", F.least(F.floor(number * cells), cells - 1).cast("bigint").alias("cell"))
    sums = placed.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    begins = common.running(sums, ["source"], "cell", "words").select(F.col("source").alias("_s"), F.col("cell").alias("_c"), "begin")
    inside = Window.partitionBy("source", "cell").orderBy("key", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(begins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("cell") == F.col("_c")))
    place = F.col("begin") + F.col("inside")
    whole = F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(F.lit(0))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - whole * F.col("source_size") - place))
    return ordered.select("doc_id", "source", "size", "source_size", "target", (whole * F.col("size") + cut).cast("bigint").alias("taken"), place.alias("place"))
