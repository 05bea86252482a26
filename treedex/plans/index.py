"""The index: files and nodes parsed once, views built lazily from them, each a relation with a domain column."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from treedex.config import Config
from treedex.functions.text import FILE_TYPES, base_name, frontmatter_tags, hashtags, selected_types
from treedex.operators import cards, domains, keywords, markdown, words
from treedex.operators.search import search_multiple, valid_patterns
from treedex.plans.lineage import cut
from treedex.sources import files as source, mindmap
from treedex.timing import Counts

NODE = ["file_path", "pre", "last", "parent_pre", "node_type", "level", "text", "content", "search_text", "node_id"]


@dataclass(frozen=True)
class Handler:
    """What reads a type of files: endings and nodes(files), tags(files, nodes) and valid(files) as DataFrames. Endings fall to the longest that fits."""

    ftype: str
    nodes: Callable[[DataFrame], DataFrame]
    tags: Callable[[DataFrame, DataFrame], DataFrame]
    valid: Callable[[DataFrame], DataFrame]

    def link(self, path: Column, node: Column | None = None) -> Column:
        return path if node is None else F.when(F.coalesce(node, F.lit("")) == "", path).otherwise(F.concat(path, F.lit("#"), node))


def text_tags(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hashtags and frontmatter tags: file_path, tag, node_id (empty: they are the file's) and label."""
    every = F.array_union(hashtags(F.col("content")), frontmatter_tags(F.col("content")))
    return files.select("file_path", F.explode(every).alias("tag"), F.lit("").alias("node_id"), base_name(F.col("file_path")).alias("label"))


def map_tags(files: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(files.select("file_path"), "file_path", "left_semi").filter("tags is not null").select("file_path", F.explode("tags").alias("tag"), "node_id", F.col("text").alias("label"))


def not_empty(files: DataFrame) -> DataFrame:
    """Files whose content was read and isn't blank."""
    return files.filter(F.coalesce("content", F.lit("")).rlike(r"\S"))


def has_nodes(files: DataFrame) -> DataFrame:
    return files.join(mindmap.nodes(files).select("file_path").distinct(), "file_path", "left_semi")


HANDLERS: dict[str, Handler] = {}


def register(handler: Handler, endings: list[str] = []) -> None:  # noqa: B006
    """Add or replace what reads a type; endings add to the known ones (FILE_TYPES)."""
    HANDLERS[handler.ftype] = handler
    for e in endings:
        if not e.startswith("."):
            raise ValueError(f"an ending begins with a dot: {e}")
        FILE_TYPES[e.lower()] = handler.ftype


register(Handler("markdown", markdown.nodes, text_tags, not_empty))
register(Handler("card", markdown.nodes, text_tags, not_empty))
register(Handler("freeplane", mindmap.nodes, map_tags, has_nodes))


class KnowledgeIndex:
    def __init__(self, files: DataFrame, areas: DataFrame, config: Config | None = None, keyword_rows: keywords.Keywords | None = None, counts: Counts | None = None):
        """files: SCHEMA of sources.files and content. counts: where numbers of stages go (`read`, `nodes` and kept views); .counts if not given."""
        self.counts = counts or Counts()
        self.config, self.areas, self.keyword_rows = config or Config(["."]), areas, keyword_rows or keywords.Keywords()
        self.files = files.withColumn("ord", F.col("file_path"))
        self._kept: dict[str, DataFrame] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: Config) -> KnowledgeIndex:
        kinds = selected_types(config.include_types, config.exclude_types)
        counts = Counts()
        found = source.discover(spark, config.include, config.exclude, kinds, config.output, counts)
        files = found.filter(~F.col("ftype").isin("area", "manifest"))
        if files.isEmpty():
            raise ValueError("no file found")
        return cls(files, cut(source.areas_of(found)), config, keywords.load([str(k) for k in config.keyword_files if isinstance(k, str)], [k for k in config.keyword_files if isinstance(k, dict)]), counts)

    @cached_property
    def nodes(self) -> DataFrame:
        out = None
        for kind, handler in HANDLERS.items():
            one = handler.nodes(self.files.filter(F.col("ftype") == kind))
            one = one.withColumn("tags", F.lit(None).cast("array<string>")) if "tags" not in one.columns else one
            one = one.select(*NODE, "tags")
            out = one if out is None else out.unionByName(one)
        return self.counts.cut("nodes", out)

    def invalid(self) -> DataFrame:
        """Files that their handler finds nothing in: file_path, ftype."""
        good = None
        for kind, handler in HANDLERS.items():
            one = handler.valid(self.files.filter(F.col("ftype") == kind)).select("file_path")
            good = one if good is None else good.unionByName(one)
        return self.files.select("file_path", "ftype").join(good, "file_path", "left_anti")

    @cached_property
    def cards(self) -> DataFrame:
        return cut(cards.with_source(cards.parse(self.files.filter("ftype = 'card'"))).withColumn("ord", F.col("file_path")).drop("fm"))

    @cached_property
    def file_domains(self) -> DataFrame:
        return cut(domains.partitioned(domains.resolved(self.files.select("file_path"), self.areas, self.cards), self.config.partition))

    @cached_property
    def domain_cards(self) -> DataFrame:
        return self.cards.drop("domain").join(self.file_domains, "file_path")

    @cached_property
    def groups(self) -> DataFrame:
        return cut(cards.groups(self.domain_cards))

    def kept(self, name: str) -> DataFrame:
        """A view, computed once and kept for the renderers, which read it several times; .counts has its rows, and of `keyword` its hits."""
        if name not in self._kept:
            self._kept[name] = self.counts.cut(name, getattr(self, name)(), **({"hits": F.count("file_path")} if name == "keyword" else {}))
        return self._kept[name]

    def view(self, name: str) -> DataFrame | None:
        """A view by name, or nothing if the configuration turns it off."""
        return getattr(self, name)() if self.config.view_enabled(name) else None

    def file_system(self) -> DataFrame:
        """domain, dir, name, file_path, ftype, annotation, hidden_card."""
        own = self.files.filter(F.col("file_path") != os.path.abspath(self.config.output)) if self.config.output else self.files
        shown = cards.not_absorbed(own.select("file_path", "dir", "name", "ftype"), self.groups).filter("ftype <> 'card'")
        notes = self.groups.select("domain", F.col("source_path").alias("file_path"), "annotation", "hidden_card")
        d = shown.join(self.file_domains, "file_path")
        return d.join(notes, (d["file_path"] == notes["file_path"]) & d["domain"].eqNullSafe(notes["domain"]), "left").select(d["domain"], "dir", "name", d["file_path"], "ftype", "annotation", "hidden_card")

    def dir_annotations(self) -> DataFrame:
        """domain, dir, essence of folder summaries."""
        return cards.dir_annotations(self.domain_cards)

    def keyword_entries(self) -> DataFrame:
        """domain and the entries of the keyword files that hold there: see keywords.chains."""
        kw = keywords.chains(self.files.sparkSession, self.keyword_rows)
        return keywords.scoped(kw, self.file_domains.select("domain").distinct()).drop("scope_domains")

    def keyword(self) -> DataFrame:
        """domain, kw_file, kw_pre, keyword, file_path, pre, node_id, ftype, text, matched: each entry's hits in the domain, nulls for a leaf without any."""
        kw = self.keyword_entries().filter("is_leaf").select("domain", "kw_file", F.col("pre").alias("kw_pre"), F.col("text").alias("keyword"), F.array_join("sequence", ":").alias("sequence"))
        terms = {t for r in self.keyword_rows.rows for t in r[8] or ()}
        good = valid_patterns(self.files.sparkSession, sorted(terms))
        usable = [list(x) for x in sorted({tuple(r[8]) for r in self.keyword_rows.rows if r[8] and all(good[t] for t in r[8])})]
        found = search_multiple(self.nodes, usable).join(self.file_domains, "file_path").join(self.files.select("file_path", "ftype"), "file_path").withColumnRenamed("domain", "_d").withColumnRenamed("sequence", "_s")
        return kw.join(found, (kw["sequence"] == found["_s"]) & kw["domain"].eqNullSafe(found["_d"]), "left").select("domain", "kw_file", "kw_pre", "keyword", "file_path", "pre", "node_id", "ftype", "text", "matched")

    def file_tags(self) -> DataFrame:
        """tag, file_path, node_id, label."""
        out = None
        for kind, handler in HANDLERS.items():
            one = handler.tags(self.files.filter(F.col("ftype") == kind), self.nodes).select("tag", "file_path", "node_id", "label")
            out = one if out is None else out.unionByName(one)
        return out

    def tag(self) -> DataFrame:
        """domain, tag, file_path, node_id, label."""
        return self.file_tags().join(self.file_domains, "file_path").select("domain", "tag", "file_path", "node_id", "label")

    def word(self) -> DataFrame:
        """domain, word, file_path, pre: words in enough files of the domain, variants under their group's label; a place may come once for each variant."""
        found = words.occurrences(self.nodes).join(self.file_domains, "file_path")
        often = found.select("domain", "word", "file_path").distinct().groupBy("domain", "word").count().filter(F.col("count") >= self.config.min_frequency).select(F.col("domain").alias("_d"), F.col("word").alias("_w"))
        kept = found.join(often, F.col("_d").eqNullSafe(found["domain"]) & (found["word"] == F.col("_w")), "left_semi")
        # a domain's words are grouped apart: they are told from others' by the domain before them
        named = kept.withColumn("word", F.concat(F.coalesce("domain", F.lit("")), F.lit("\x1f"), "word"))
        groups = words.consolidate(words.first_files(named), by_domain=True).select(F.col("label").alias("_l"), F.col("word").alias("_w"))
        return named.select("domain", "word", "file_path", "pre").distinct().join(groups, named["word"] == groups["_w"]).select("domain", F.element_at(F.split("_l", "\x1f"), -1).alias("word"), "file_path", "pre")

    def dependencies(self) -> DataFrame:
        return cards.dependencies(self.domain_cards)

    def glossary(self) -> DataFrame:
        return cards.glossary(self.domain_cards)


def merged(view: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All domains' rows as one: of rows with one key the last by order counts."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return view.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "domain")


class Merged:
    """All domains of an index as one: files, tags, words, keywords and dependencies together, groups, annotations and terms by the last domain that has them."""

    def __init__(self, index: KnowledgeIndex):
        self.index, self.config, self.files, self.nodes = index, index.config, index.files, index.nodes
        self.file_domains = index.file_domains.withColumn("domain", F.lit(None).cast("string"))
        self.groups = cut(self._last(index.groups, ["source_path"]))
        self._kept: dict[str, DataFrame] = {}
        self.counts = Counts()

    kept = KnowledgeIndex.kept

    @staticmethod
    def _last(view: DataFrame, key: list[str]) -> DataFrame:
        rank = view.withColumns({"_n": F.when(F.col("domain").isNull(), 2).when(F.col("domain") == "none", 1).otherwise(0), "_d": F.lower("domain")})
        return merged(rank, key, ["_n", "_d"]).drop("_n", "_d").withColumn("domain", F.lit(None).cast("string"))

    def _all(self, view: DataFrame, kept: list[str]) -> DataFrame:
        return view.select(F.lit(None).cast("string").alias("domain"), *kept).distinct()

    def file_system(self) -> DataFrame:
        v = self.index.kept("file_system")
        return self._all(v, [c for c in v.columns if c not in ("domain", "annotation", "hidden_card")])

    def dir_annotations(self) -> DataFrame:
        return self._last(self.index.kept("dir_annotations"), ["dir"])

    def keyword_entries(self) -> DataFrame:
        v = self.index.kept("keyword_entries")
        return self._all(v, [c for c in v.columns if c != "domain"])

    def keyword(self) -> DataFrame:
        v = self.index.kept("keyword")
        return self._all(v, [c for c in v.columns if c != "domain"])

    def tag(self) -> DataFrame:
        return self._all(self.index.kept("tag"), ["tag", "file_path", "node_id", "label"])

    def word(self) -> DataFrame:
        return self._all(self.index.kept("word"), ["word", "file_path", "pre"])

    def dependencies(self) -> DataFrame:
        return self._all(self.index.kept("dependencies"), ["src_path", "src_title", "pos", "tgt_label", "tgt_path"])

    def glossary(self) -> DataFrame:
        return self._last(self.index.kept("glossary"), ["term"])

    def view(self, name: str) -> DataFrame | None:
        return getattr(self, name)() if self.config.view_enabled(name) else None
