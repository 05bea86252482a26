"""Cards: Markdown with YAML frontmatter that summarises a source; groups, annotations, dependencies, glossary."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from treedex.functions.text import base_name, essence, frontmatter, local_source, normal_path, parent_dir

LISTS = ("source", "tags", "builds_on", "defines", "exported_as", "refines")
TEXTS = ("id", "slug", "kind", "title", "domain", "created", "updated", "source_hash")


@F.pandas_udf(StringType())
def yaml_json(block: pd.Series) -> pd.Series:
    """A YAML mapping as JSON, values that JSON lacks as text; anything else an empty mapping."""
    import yaml

    def one(x):
        try:
            v = yaml.safe_load(x) if x else {}
        except yaml.YAMLError:
            v = {}
        return json.dumps(v if isinstance(v, dict) else {}, default=str, ensure_ascii=False)

    return block.map(one)


def parse(files: DataFrame) -> DataFrame:
    """files: file_path, content. One row a file: its fields, lists as arrays, essence, and all of the frontmatter as a variant."""
    f = files.select("file_path", "content", yaml_json(frontmatter(F.col("content"))).alias("_j"))
    body = F.regexp_replace("content", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    text = lambda k: F.get_json_object("_j", f"$.{k}")

    def listed(k: str):
        v = text(k)
        many = F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull())
        one = F.filter(F.transform(F.split(v, ","), F.trim), lambda x: x != "") if k == "tags" else F.array(v)
        return F.when(v.isNull(), F.array().cast("array<string>")).when(v.startswith("["), many).otherwise(one)

    return f.select("file_path", *(text(k).alias(k) for k in TEXTS if k != "title"), F.coalesce(text("title"), base_name(F.col("file_path"))).alias("title"), *(listed(k).alias(k) for k in LISTS), essence(body).alias("essence"), F.parse_json("_j").alias("fm"))


def with_source(cards: DataFrame) -> DataFrame:
    """Adds source_path: the first local source, resolved against the card's folder; without one, the folder above the card's."""
    here, src = parent_dir(F.col("file_path")), local_source(F.col("source"))
    return cards.withColumn("source_path", F.when(src.isNull(), parent_dir(here)).when(src.startswith("/"), normal_path(src)).otherwise(normal_path(F.concat(here, F.lit("/"), src))))


def groups(cards: DataFrame) -> DataFrame:
    """By domain and source_path: annotation, hidden_card, cards, exported_as, refines. cards: with ord, the order of files.

    A file summary annotates (and, beside topics, is hidden); without one, a single topic does; more topics give none.
    """
    c = cards.filter(F.coalesce("kind", F.lit("")) != "dir_summary")
    summary = F.coalesce(F.col("kind") == "file_summary", F.lit(False))
    g = c.groupBy("domain", "source_path").agg(
        F.count_if(summary).alias("s"), F.count_if(~summary).alias("t"), F.min_by(F.when(summary, F.col("essence")), F.when(summary, F.col("ord"))).alias("se"), F.min_by(F.when(summary, F.col("file_path")), F.when(summary, F.col("ord"))).alias("sp"),
        F.min_by(F.when(~summary, F.col("essence")), F.when(~summary, F.col("ord"))).alias("te"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "title", "file_path", "essence"))), lambda x: F.struct(x["title"].alias("label"), x["file_path"].alias("path"), x["essence"].alias("essence"))).alias("cards"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "exported_as"))), lambda x: x["exported_as"]))).alias("exported_as"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "refines"))), lambda x: x["refines"]))).alias("refines"),
    )
    return g.select("domain", "source_path", F.when(F.col("s") > 0, F.col("se")).when(F.col("t") == 1, F.col("te")).alias("annotation"), F.when((F.col("s") > 0) & (F.col("t") > 0), F.col("sp")).alias("hidden_card"), "cards", "exported_as", "refines")


def dir_annotations(cards: DataFrame) -> DataFrame:
    """domain, dir, essence of folder summaries; the last file in order counts."""
    d = cards.filter("kind = 'dir_summary' and essence <> ''").withColumn("dir", F.col("source_path"))
    return d.groupBy("domain", "dir").agg(F.max_by("essence", "ord").alias("essence"))


def dependencies(cards: DataFrame) -> DataFrame:
    """domain, src_path, src_title, pos (place in the list), tgt_label, tgt_path: references resolved by slug or id; an unresolved one keeps its text and has no path."""
    keys = cards.select(F.col("slug").alias("ref"), "ord", "title", "file_path").unionByName(cards.select(F.col("id").alias("ref"), "ord", "title", "file_path")).filter("ref is not null")
    keys = keys.groupBy("ref").agg(F.max_by(F.struct("title", "file_path"), "ord").alias("t"))
    d = cards.select("domain", F.col("file_path").alias("src_path"), F.col("title").alias("src_title"), F.posexplode("builds_on").alias("pos", "ref"))
    return d.join(keys, "ref", "left").select("domain", "src_path", "src_title", "pos", F.coalesce("t.title", "ref").alias("tgt_label"), F.col("t.file_path").alias("tgt_path"))


def glossary(cards: DataFrame) -> DataFrame:
    """domain, term, title, file_path; of cards that define a term the last counts."""
    t = cards.select("domain", "ord", "title", "file_path", F.posexplode("defines").alias("pos", "term"))
    return t.groupBy("domain", "term").agg(F.max_by(F.struct("title", "file_path"), F.struct("ord", "pos")).alias("r")).select("domain", "term", "r.title", "r.file_path")


def not_absorbed(files: DataFrame, groups_: DataFrame) -> DataFrame:
    """Files that no group exports or refines; cards stay."""
    gone = groups_.select(F.explode(F.concat("exported_as", "refines")).alias("file_path")).distinct()
    return files.join(gone, "file_path", "left_anti").unionByName(files.join(gone, "file_path", "left_semi").filter("ftype = 'card'"))
