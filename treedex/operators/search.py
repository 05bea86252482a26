"""Hierarchical search: `a:b:c` finds c below b below a.

The first term takes all matching nodes; each middle term the first match (smallest pre) in each earlier match's subtree; the last term all matches there.
A node is in its own subtree. Results are bags: matches that overlap give their hits again; dedup() takes the first of each.
"""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame, Window, functions as F

from treedex.functions import patterns as patterns_
from treedex.functions.text import boundary
from treedex.operators.tree import covered


def split_terms(text: str, brackets: bool = True) -> list[str]:
    """Terms at colons; with brackets, colons inside [..] stay."""
    parts = re.split(r":(?![^\[]*\])" if brackets else ":", text)
    return [p.strip() for p in parts if p.strip()]


def valid_patterns(spark, patterns: list[str]) -> dict[str, bool]:
    """Which patterns are valid: taken by Python between word boundaries, and by Java as translated; one bad pattern would fail a whole query."""
    out = {}
    for p in patterns:
        out[p] = patterns_.valid(p)
        if out[p] and re.search(r"[^\w\s-]", p):
            try:
                spark._jvm.java.util.regex.Pattern.compile(boundary(p))
            except Exception:
                out[p] = False
    return out


# --- many terms at once

#: Signs that stand for themselves in a pattern, and words of a literal text.
_LITERAL, _RUN = re.compile(r"(?:[\w \-',/&@%=<>!\";~`:]|\\[^\w\s])+"), re.compile(r"\w+")
#: Buckets of the words that are looked for, so that a word of a text meets few of them.
_BUCKETS = 4096
#: Capitals whose small letter has another capital, and those small letters. Spark drops one of two nested changes of case, so they are replaced first.
_ODD, _SMALL = "\u0130\u03f4\u1e9e\u2126\u212a\u212b", "i\u03b8\u00df\u03c9k\u00e5"


def folded(text: Column) -> Column:
    """Equal for texts that Java's patterns of any case take for equal."""
    return F.upper(F.translate(text, _ODD, _SMALL))


def _fold(word: str) -> str:
    return word.translate(str.maketrans(_ODD, _SMALL)).upper()


def required_words(term: str) -> list[tuple[str, bool]] | None:
    """For each alternative of a term that is literal text, its longest word, folded, which a matching text has as a word of its own, and whether it is all of the alternative. None if the term isn't such.

    The boundaries around a term make each run of letters, digits and _ in an alternative a whole word of the text.
    """
    out = []
    for part in term.split("|"):
        if not _LITERAL.fullmatch(part):
            return None
        runs = _RUN.findall(part)
        key = max(map(_fold, runs), key=len, default="")
        # a word that changes its length in upper case stands for texts of several lengths
        if not key or any(len(x) != len(_fold(x)) for x in runs):
            return None
        out.append((key, runs == [part]))
    return out


def matched_terms(text: Column, terms: list[str]) -> Column:
    """An array of the numbers of the terms that a text matches, as rlike(boundary(term)) would say, each once; null text matches none.

    Literal terms are found by their words: the text is cut into words once, and each is looked up, so what a text costs doesn't grow with the number of terms. A term of several words is
    compared in full where its longest word occurs, and so is any term where a letter of the text changes its length in upper case. Terms with other signs are patterns of their own.
    """
    index: list[dict[str, list[dict]]] = [{} for _ in range(_BUCKETS)]
    rest, looked = [], False
    for i, t in enumerate(terms):
        words = required_words(t)
        if words is None:
            rest.append(F.when(text.rlike(boundary(t)), F.lit(i)))
            continue
        looked = True
        for key, all_ in words:
            entry = {"i": i, "p": boundary(t), "a": all_}
            of_key = index[zlib.crc32(key.encode()) % _BUCKETS].setdefault(key, [])
            if entry not in of_key:
                of_key.append(entry)
    found = F.array().cast("array<int>")
    if looked:
        kind = "array<map<string,array<struct<i:int,p:string,a:boolean>>>>"
        table = F.from_json(F.lit(json.dumps(index)), F.lit(kind))
        plain = F.length(text) == F.length(folded(text))
        words = F.array_distinct(F.regexp_extract_all(folded(text), F.lit(r"(?U)\w+"), F.lit(0)))
        entries = F.transform(words, lambda w: F.try_element_at(F.try_element_at(table, (F.crc32(w.cast("binary")) % _BUCKETS + 1).cast("int")), w))
        sure = F.filter(F.flatten(F.filter(entries, lambda e: e.isNotNull())), lambda e: F.when(e["a"] & plain, F.lit(True)).otherwise(F.regexp_like(text, e["p"])))
        found = F.coalesce(F.transform(sure, lambda e: e["i"]), found)
    if rest:
        found = F.concat(found, F.filter(F.array(*rest), lambda x: x.isNotNull()))
    return F.array_distinct(found)


def found_sequences(nodes: DataFrame, sequences: list[list[str]]) -> DataFrame:
    """All sequences' hits as file_path, pre, p (the node's other columns), s (number of the sequence) and times: how often the sequence finds the node.

    Each node's text is searched once, whatever the number of sequences. Sequences that differ in their last term alone share a stem: its terms' matches and all the last terms' are rows of
    the stem, so a stem with many leaves costs its rows once. Then a stage is a running sum by stem and file: of a middle term, a match takes the weights of the matches since
    the one before it whose subtrees reach it; of the last term, a match is found as often as matches of the stem stand at or above it.
    """
    cols = [c for c in ("text", "search_text", "node_id", "node_type") if c in nodes.columns]
    terms = sorted({t for s in sequences for t in s})
    number = {t: i for i, t in enumerate(terms)}
    stems = {stem: i for i, stem in enumerate(sorted({tuple(s[:-1]) for s in sequences}))}
    uses: list[list[dict]] = [[] for _ in terms]  # by term: what it is in stems: a place from 0, or the last term of a sequence
    for i, s in enumerate(sequences):
        uses[number[s[-1]]].append({"stem": stems[tuple(s[:-1])], "k": len(s) - 1, "at": -1, "s": i})
    for stem, i in stems.items():
        for at, t in enumerate(stem):
            uses[number[t]].append({"stem": i, "k": len(stem), "at": at, "s": -1})
    kind = "array<array<struct<stem:int,k:int,at:int,s:int>>>"
    table = F.from_json(F.lit(json.dumps(uses)), F.lit(kind))
    n = nodes.select("file_path", "pre", "last", F.struct(*cols).alias("p"), matched_terms(F.col("search_text"), terms).alias("_t"))
    # outer: else Spark would look for empty arrays first and so match the terms twice
    u = n.select("file_path", "pre", "last", "p", F.explode_outer(F.flatten(F.transform("_t", lambda i: F.try_element_at(table, i + 1)))).alias("u")).filter("u is not null").select("file_path", "pre", "last", "p", "u.*")
    alone = u.filter("k = 0").select("file_path", "pre", "p", "s", F.lit(1).cast("bigint").alias("times"))
    most = max(map(len, sequences)) - 1
    if most < 1:
        return alone
    by = ["stem", "file_path"]
    met = u.filter("k > 0").repartition(*by).groupBy(*by, "pre", "last", "k").agg(F.first("p").alias("p"), F.array_distinct(F.collect_list("at")).alias("f"), F.collect_list(F.when(F.col("s") >= 0, F.col("s"))).alias("ends"))
    now = met.withColumn("w", F.array_contains("f", 0).cast("bigint"))
    for i in range(1, most):
        here = F.array_contains("f", i)
        stretch = F.coalesce(F.sum(here.cast("bigint")).over(Window.partitionBy(*by).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        now = now.withColumn("g", stretch)
        whole = Window.partitionBy(*by, "g")
        now = now.withColumn("_n", F.max(F.when(here, F.col("pre"))).over(whole))
        came = F.sum(F.when(F.col("last") >= F.col("_n"), F.col("w"))).over(whole)
        now = now.withColumn("w", F.when(F.col("k") > i, F.when(here, F.coalesce(came, F.lit(0))).otherwise(0)).otherwise(F.col("w"))).drop("g", "_n")
    held = covered(now, F.col("w"), by).filter(F.col("cover") > 0)
    below = held.select("file_path", "pre", "p", F.explode("ends").alias("s"), F.col("cover").alias("times"))
    return alone.unionByName(below) if any(len(s) == 1 for s in sequences) else below


def search_counts(nodes: DataFrame, sequences: list[list[str]]) -> DataFrame:
    """sequence (terms joined by colons), file_path, pre, times: hits of all sequences as numbers; a bag of them would grow with the square of a chain's length."""
    names = [":".join(s) for s in sequences if s]
    if not names:
        return nodes.select(F.lit("").alias("sequence"), "file_path", "pre", F.lit(1).cast("bigint").alias("times")).limit(0)
    return found_sequences(nodes, [s for s in sequences if s]).select(_pick(names, "s").alias("sequence"), "file_path", "pre", "times")


def _pick(values: list, at: str) -> Column:
    kind = "array<string>" if isinstance(values[0], str) else "array<array<string>>"
    return F.from_json(F.lit(json.dumps(values)), F.lit(kind))[F.col(at)]


def search_multiple(nodes: DataFrame, sequences: list[list[str]]) -> DataFrame:
    """nodes: file_path, pre, last, search_text, text. All sequences' hits with `sequence`, joined by colons, as a bag; a sequence without hits has no row."""
    sequences = [s for s in sequences if s]
    cols = [c for c in ("node_id",) if c in nodes.columns]
    out = lambda rows, path, sequence: rows.select("file_path", "pre", *(F.col(f"p.{c}") for c in cols), "p.text", F.col("p.search_text").alias("matched"), path.alias("search_path"), sequence.alias("sequence"))
    if not sequences:
        kept = [c for c in ("text", "search_text", "node_id") if c in nodes.columns]
        return out(nodes.limit(0).select("file_path", "pre", F.struct(*kept).alias("p")), F.array().cast("array<string>"), F.lit("").cast("string"))
    held = found_sequences(nodes, sequences)
    held = held.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return out(held, _pick(sequences, "s"), _pick([":".join(s) for s in sequences], "s"))


def search_sequence(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Hits of one sequence: file_path, pre, node_id if there is one, text, matched, search_path. No terms: no hits."""
    return search_multiple(nodes, [terms]).drop("sequence")


def search_single(nodes: DataFrame, term: str) -> DataFrame:
    return search_sequence(nodes, [term])


def search_files(nodes: DataFrame, text: str, files: list[str] | None = None) -> DataFrame:
    """A sequence written as `a:b:c`, split at every colon, in all files or those named. A term that isn't a pattern finds nothing."""
    terms = split_terms(text, brackets=False)
    if not all(valid_patterns(nodes.sparkSession, terms).values()):
        terms = []
    return search_sequence(nodes if files is None else nodes.filter(F.col("file_path").isin(files)), terms)


def group_by_file(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_path").agg(F.count("*").alias("n"))


def group_by_path(hits: DataFrame) -> DataFrame:
    return hits.groupBy("search_path").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files"))


def dedup(hits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One hit of each node: the first by order, then by its path and what else it holds, so that the row kept is always the same."""
    w = Window.partitionBy("file_path", "pre").orderBy(*(order or ["text"]), *(c for c, kind in hits.dtypes if not kind.startswith("map")))
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def sort_results(hits: DataFrame, by: str = "file_path") -> DataFrame:
    """By file, text or path of the search, ties by the node's place; any other name leaves the order as it is."""
    keys = {"file_path": ["file_path", "text"], "node_text": ["text", "file_path"], "search_path": [F.size("search_path"), "file_path", "text"]}
    return hits.orderBy(*keys[by], "file_path", "pre") if by in keys else hits


def filter_by_type(hits: DataFrame, endings: list[str]) -> DataFrame:
    keep = F.lit(False)
    for e in endings:
        keep = keep | F.col("file_path").endswith(e)
    return hits.filter(keep)


def grep(files: DataFrame, pattern: str, ignore_case: bool = False, word: bool = False, invert: bool = False, content: str = "content") -> DataFrame:
    """Lines of files that match: path, line_no (from 1), line."""
    flags = ("(?iu)" if ignore_case else "") + (rf"(?U)\b(?:{pattern})\b" if word else pattern)
    lines = files.select("path", F.posexplode(F.split(content, "\n")).alias("i", "line")).select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    hit = F.col("line").rlike(flags)
    return lines.filter(~hit if invert else hit)


def grep_files(hits: DataFrame) -> DataFrame:
    return hits.select("path").distinct()


def grep_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count("*").alias("n"))


def grep_context(files: DataFrame, hits: DataFrame, around: int, content: str = "content", after: int | None = None) -> DataFrame:
    """Lines at most so many before a hit (and `after` behind it, if that differs), each once."""
    after = around if after is None else after
    near = hits.select("path", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + after)).alias("line_no")).distinct()
    lines = files.select("path", F.posexplode(F.split(content, "\n")).alias("i", "line")).select("path", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")
    return lines.join(near, ["path", "line_no"])
