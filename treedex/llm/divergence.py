"""Audit of how sources of a language differ in their words.

Each kept term of a language is one wide row: its counts by source, in the order of the language's sources. Higher-order functions turn the counts into
smoothed shares, whole numbers in parts of UNIT, and give the differences of every pair of sources; these are summed before the shuffle, so that what
leaves a task is a row a pair, however many terms it had.

Terms are counted by text in Python workers that keep a bounded table of counts, and added up by Spark.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Documents of a language that a kept term is in, at least; added to each count; parts of a share; terms listed for each source.
LEAST, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Counts that a worker holds before it hands them on, and bytes of text split into words at once.
HELD, PIECE = 1 << 18, 1 << 20

#: By byte: letters lower-cased, bytes of other characters as they are, all else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb" ")


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term; a long text is split piece by piece."""
    raw, out, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        out.update(raw[at:end].split())
        at = end + 1
    return out


def _rows(held: dict) -> pa.RecordBatch:
    keys = [(*g, t) for g, terms in held.items() for t in terms]
    n = [x for terms in held.values() for x in terms.values()]
    lang, source, term = zip(*keys, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string(), safe=False), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], ["lang", "source", "term", "n", "docs"])


def _count(batches):
    """lang, source, text to parts of the counts of lang, source, term: occurrences and texts."""
    held, size = {}, 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2)
        for i in range(len(langs)):
            terms = held.setdefault((langs[i], sources[i]), {})
            size -= len(terms)
            for t, n in term_counts(texts[i].as_buffer().to_pybytes()).items():
                if t in terms:
                    x = terms[t]
                    x[0] += n
                    x[1] += 1
                else:
                    terms[t] = [n, 1]
            size += len(terms)
            if size > HELD:
                yield _rows(held)
                held, size = {}, 0
    if size:
        yield _rows(held)


def _share(n: str, total: str, terms: str) -> str:
    """1 + floor(UNIT * (n + ADDED) / (total + ADDED * terms)), exactly."""
    return f"CAST(1 + (CAST({n} + {ADDED} AS decimal(20,0)) * CAST({UNIT} AS decimal(12,0))) DIV CAST({total} + {ADDED} * {terms} AS decimal(20,0)) AS bigint)"


def wide(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, total, found (structs source, n) of each kept term: those in at least that many documents of the language."""
    common.prepare(docs.sparkSession)
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    parts = named.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a list of a language's sources at most, an entry each
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found")).filter(F.col("docs") >= least).drop("docs")


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, sources, totals (by source, in code-point order), terms, total: a row a language, with kept terms and their occurrences."""
    occurring = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.select("lang", F.explode("found").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    each = occurring.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return each.join(by_lang, "lang", "left").select("lang", F.col("x.source").alias("sources"), F.col("x.n").alias("totals"), zero("terms"), zero("total"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: how far each other source of the language is, over all its kept terms. Part `term`: the kept terms that the source has and uses more than its language does, the top ones. Null text,
    language and source are empty strings; a source without terms has the shares of counts of 0; a language without kept terms has pairs of value 0 and no term. Rows with one id are documents of their
    own. An empty table gives no row. Other columns aren't read.

    The terms of a language which holds many of all are dealt over tasks, with a copy of its sources for each.
    """
    kept = common.written(wide(docs, least), "terms")
    langs = common.written(groups(docs, kept), "sources")
    rows = common.with_group(kept.withColumnRenamed("total", "q_n"), langs, "lang", "terms", F.xxhash64("term"))
    rows = rows.withColumn("found", F.map_from_entries("found")).withColumn("counts", F.expr("transform(sources, s -> coalesce(try_element_at(found, s), 0L))"))
    share = F.expr(f"transform(arrays_zip(counts, totals), x -> {_share('x.counts', 'x.totals', 'terms')})")
    shares = common.written(rows.select("lang", "term", "sources", "counts", share.alias("p"), F.expr(_share("q_n", "total", "terms")).alias("q")), "shares")

    # places a < b of two sources; a term's row goes out once for each a, so no row holds all its pairs
    first = shares.select("lang", F.posexplode("p").alias("a", "pa"), "p")
    gaps = first.select("lang", "a", F.posexplode(F.expr("transform(slice(p, a + 2, size(p)), x -> abs(x - pa))")).alias("b", "value"))
    none = langs.filter("terms = 0").select("lang", F.posexplode("sources").alias("a", "_"), "sources").select("lang", "a", F.posexplode(F.expr("transform(slice(sources, a + 2, size(sources)), x -> 0L)")).alias("b", "value"))
    sums = gaps.unionByName(none).groupBy("lang", "a", (F.col("a") + F.col("b") + 1).alias("b")).agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    names = langs.select("lang", F.posexplode("sources").alias("place", "name"))
    pairs = sums.select("lang", "value", both.alias("z")).select("lang", "value", "z.*")
    pairs = pairs.join(names.select("lang", F.col("place").alias("x"), F.col("name").alias("source")), ["lang", "x"]).join(names.select("lang", F.col("place").alias("y"), F.col("name").alias("item")), ["lang", "y"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    used = shares.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "counts", "p")).alias("x")).filter("x.counts > 0 AND x.p > q")
    terms = used.select("lang", "x.sources", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).alias("value")).withColumnRenamed("sources", "source")
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms)
