"""Domains: a card's own, else that of the nearest area above, else none."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from treedex.functions.text import ancestors


def nearest_area(files: DataFrame, areas: DataFrame) -> DataFrame:
    """files: file_path. areas: dir, and more. Each file with its nearest area's row as struct `area`, null without one: an equi-join on folders above."""
    up = files.select("file_path", F.explode(ancestors(F.col("file_path"))).alias("dir"))
    near = up.join(areas, "dir").groupBy("file_path").agg(F.max_by(F.struct(*areas.columns), F.size(F.split("dir", "/"))).alias("area"))
    return files.join(near, "file_path", "left")


def resolved(files: DataFrame, areas: DataFrame, card_domains: DataFrame) -> DataFrame:
    """file_path, domain. The nearest area counts even where it names no domain."""
    return nearest_area(files, areas).join(card_domains.select("file_path", F.col("domain").alias("_own")), "file_path", "left").select("file_path", F.coalesce("_own", "area.domain").alias("domain"))


def partitioned(file_domains: DataFrame, mode: str = "auto") -> DataFrame:
    """Buckets: with partitioning, domains and `none`; else one null bucket. auto: whether any file has a domain, decided in the plan."""
    if mode == "off":
        return file_domains.withColumn("domain", F.lit(None).cast("string"))
    bucket = F.coalesce("domain", F.lit("none"))
    if mode == "on":
        return file_domains.withColumn("domain", bucket)
    some = file_domains.agg(F.max(F.col("domain").isNotNull())).scalar()
    return file_domains.withColumn("domain", F.when(some, bucket))


def in_order(rows: DataFrame) -> DataFrame:
    """Domains in any case's order, then none, then null."""
    return rows.orderBy(F.when(F.col("domain").isNull(), 2).when(F.col("domain") == "none", 1).otherwise(0), F.lower("domain"), "domain")


def counts(file_domains: DataFrame) -> DataFrame:
    return file_domains.groupBy("domain").agg(F.count("*").alias("n"))
