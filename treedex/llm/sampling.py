"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, unsigned."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Labels up to which each has per_label rows; more share as many rows as these.
FULL_LABELS = 64


def by_label(rows: DataFrame, label: str, per_label: int, salt: int) -> DataFrame:
    """Rows (doc_id, label): of each label about per_label (1.2 times at most, but for chance), chosen by a hash of doc_id. Labels are counted over all rows.

    With over FULL_LABELS labels each has fewer, so that all have about FULL_LABELS * per_label together; every label with a doc_id keeps one at least.
    """
    place = F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    named = rows.filter(F.col(label).isNotNull()).withColumn("_place", place)
    counts = named.groupBy(label).agg(F.count("*").alias("_n"), F.min("_place").alias("_least"))
    n_labels = counts.count()
    each = per_label * min(1.0, FULL_LABELS / max(1, n_labels))
    kept = named.join(F.broadcast(counts), label).filter((F.col("_place") < F.lit(1.1 * each) / F.col("_n")) | (F.col("_place") == F.col("_least")))
    return kept.select(*rows.columns)
