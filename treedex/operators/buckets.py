"""Buckets that keep a level of an index small: ranges, letters, types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from treedex.plans.lineage import cut

MOST = 20


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, nulls equal too, whose right side may come from the left one: its keys are renamed first and left out after."""
    r = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(r, on, how).drop(*(f"_r_{k}" for k in keys))


def numbered(items: DataFrame, parent: str, order: list[Column]) -> DataFrame:
    """Adds place: each item's number among its parent's in order, from 1. Items are dealt by ranges, numbered within each, and moved up by what lies before: no task
    has more than a range, however many children a parent has."""
    dealt = cut(items.repartitionByRange(F.col(parent), *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(parent, "_part").orderBy(*order)
    counts = dealt.groupBy(parent, "_part").agg(F.count("*").alias("_c"))  # a row for each parent and range that has any
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.partitionBy(parent).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return null_safe_join(dealt.withColumn("place", F.row_number().over(here)), before, [parent, "_part"]).withColumn("place", F.col("place") + F.col("_b")).drop("_part", "_b")


def range_chunks(items: DataFrame, parent: str, key: str, most: int = MOST) -> DataFrame:
    """Children of a parent in even chunks of at most `most`, labelled by the first three letters of their ends: adds chunk and label."""
    n = items.groupBy(parent).agg(F.count("*").alias("_total"))
    size = F.ceil(F.col("_total") / F.ceil(F.col("_total") / most))
    out = null_safe_join(numbered(items, parent, [F.lower(key), F.col(key)]), n, [parent]).withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("bigint")).drop("place", "_total")
    cut_ = lambda c: F.upper(F.substring(c, 1, 3))
    by = F.struct(F.lower(key), key)
    ends = out.groupBy(parent, "chunk").agg(cut_(F.min_by(key, by)).alias("_a"), cut_(F.max_by(key, by)).alias("_z"))
    label = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise(F.concat("_a", F.lit("–"), "_z"))
    return null_safe_join(out, ends, [parent, "chunk"]).withColumn("label", label).drop("_a", "_z")


def letter(key: Column) -> Column:
    first = F.upper(F.substring(key, 1, 1))
    return F.when(first.rlike(r"^\p{L}$"), first).otherwise("#")


def letter_buckets(items: DataFrame, parent: str, key: str, most: int = MOST) -> DataFrame:
    """Adds bucket: a letter (# for others) if the parent has more than `most` children, else null."""
    n = items.groupBy(parent).agg(F.count("*").alias("_n"))
    return items.join(n, parent).withColumn("bucket", F.when(F.col("_n") > most, letter(F.col(key)))).drop("_n")


def type_rank(name: Column) -> Column:
    return F.when(name.endswith(".mm"), 0).when(name.endswith(".kb.md"), 2).when(name.endswith(".md") | name.endswith(".markdown"), 1).otherwise(3)


def type_buckets(items: DataFrame, parent: str, key: str, most: int = MOST) -> DataFrame:
    """Adds bucket: the rank of the file's type if the parent has more than `most` children of two types or more, else null."""
    n = items.groupBy(parent).agg(F.count("*").alias("_n"), F.count_distinct(type_rank(F.col(key))).alias("_k"))
    return items.join(n, parent).withColumn("bucket", F.when((F.col("_n") > most) & (F.col("_k") > 1), type_rank(F.col(key)))).drop("_n", "_k")


#: Names of the type buckets, by rank.
TYPES = ("Mind maps (.mm)", "Markdown (.md)", "Cards (.kb.md)", "Other")


def letter_path(items: DataFrame, parents: list[str], key: str, most: int = MOST) -> DataFrame:
    """Adds buckets: the labels above each item in a list that may be long, none for up to `most` items of a parent; then letters, and ranges where a letter is long."""
    n = items.groupBy(*parents).agg(F.count("*").alias("_n"))
    out = null_safe_join(items, n, parents).withColumn("_l", F.when(F.col("_n") > most, letter(F.col(key))))
    m = out.filter("_l is not null").groupBy(*parents, "_l").agg(F.count("*").alias("_m"))
    m = m.filter(F.col("_m") > most)
    long = null_safe_join(out, m.drop("_m"), [*parents, "_l"], "left_semi").withColumn("_p", F.struct(*parents, "_l"))
    long = range_chunks(long, "_p", key, most).withColumn("buckets", F.array(F.struct(F.lit(0).alias("r"), F.col("_l").alias("a")), F.struct(F.col("chunk").cast("int").alias("r"), F.col("label").alias("a"))))
    short = null_safe_join(out, m.drop("_m"), [*parents, "_l"], "left_anti").withColumn("buckets", F.when(F.col("_l").isNull(), F.array().cast("array<struct<r:int,a:string>>")).otherwise(F.array(F.struct(F.lit(0).alias("r"), F.col("_l").alias("a")))))
    return long.select(*items.columns, "buckets").unionByName(short.select(*items.columns, "buckets"))


def file_path_buckets(items: DataFrame, parents: list[str], key: str, link: str, most: int = MOST) -> DataFrame:
    """As letter_path() for a list of files: by type first if there are two types or more."""
    n = items.groupBy(*parents).agg(F.count("*").alias("_n"), F.count_distinct(type_rank(F.col(link))).alias("_k"))
    out = null_safe_join(items, n, parents).select(*items.columns, F.when((F.col("_n") > most) & (F.col("_k") > 1), type_rank(F.col(link))).alias("_t"))
    named = letter_path(out, [*parents, "_t"], key, most)
    top = F.array(F.struct(F.col("_t").cast("int").alias("r"), F.element_at(F.array(*map(F.lit, TYPES)), F.col("_t") + 1).alias("a")))
    return named.withColumn("buckets", F.when(F.col("_t").isNull(), F.col("buckets")).otherwise(F.concat(top, "buckets"))).drop("_t")
