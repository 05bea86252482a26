"""Renderers. A view becomes an outline: rows with a path of sort keys, so that one sort puts every line in its place and a line's depth is its path's length.

Spark sorts and writes the lines; the driver only puts finished files in their places. A mind map's closing tags follow from the next row's depth.
"""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window, functions as F

from treedex.functions.text import MARKER, base_name, common_prefix, display_path, domain_slug, markdown_link, parent_dir, relative_link, shortened
from treedex.operators import buckets, keywords, words
from treedex.plans.index import KnowledgeIndex, Merged
from treedex.plans.lineage import cut

ORDER = ("file_system", "keyword", "tag", "word", "dependencies", "glossary")
TITLES = {"file_system": "File System", "keyword": "Keyword Index", "tag": "Tag Index", "word": "Word Index", "dependencies": "Dependencies", "glossary": "Glossary"}
KEY = "struct<r:int,a:string,b:string>"
#: Of rows: domain, path, text, link, note (a mind map's details; in Markdown text behind the link).
ROW = ["domain", "path", "text", "link", "note"]


def marker(at: datetime | None = None) -> str:
    return f"<!-- {MARKER} v=1 at={(at or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H:%M:%SZ')} -->"


def key(rank, text: Column, more: Column | None = None) -> Column:
    """One level of a path: sorted by rank, text and more, nulls as empty."""
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    none = F.lit("")
    return F.struct(rank.cast("int").alias("r"), F.coalesce(text, none).alias("a"), F.coalesce(more, none).alias("b") if more is not None else none.alias("b"))


def row(path: Column, text: Column, link: Column | None = None, note: Column | None = None) -> list[Column]:
    null = F.lit(None).cast("string")
    return [F.col("domain"), path.cast(f"array<{KEY}>").alias("path"), text.alias("text"), (null if link is None else link).alias("link"), (null if note is None else F.nullif(note, F.lit(""))).alias("note")]


def bucket_keys(column: str = "buckets") -> Column:
    return F.transform(F.col(column), lambda x: F.struct(x["r"], x["a"], F.lit("").alias("b")))


def bucket_rows(rows: DataFrame, at: int) -> DataFrame:
    """A row for each bucket above some rows: path prefixes of length at + 1 and on, up to the buckets' depth. rows: domain, path, buckets."""
    b = rows.filter(F.size("buckets") > 0).select("domain", "path", "buckets", F.explode(F.sequence(F.lit(1), F.size("buckets"))).alias("k"))
    return b.select(*row(F.slice("path", F.lit(1), F.lit(at) + F.col("k")), F.element_at("buckets", F.col("k"))["a"])).distinct()


# --- the file system: files, card groups under their sources, and folders


def base_folder(index) -> DataFrame:
    """domain, base: the folder that holds all of a domain's entries, from the folders' first and last name in order."""
    dirs = index.kept("file_system").select("domain", "dir").unionByName(index.groups.select("domain", parent_dir(F.col("source_path")).alias("dir")))
    ends = dirs.groupBy("domain").agg(F.split(F.min(F.concat("dir", F.lit("/"))), "/").alias("x"), F.split(F.max(F.concat("dir", F.lit("/"))), "/").alias("y"))
    same = F.aggregate(F.sequence(F.lit(0), F.least(F.size("x"), F.size("y")) - 1), F.lit(0), lambda n, i: F.when((n == i) & (F.get("x", i) == F.get("y", i)), n + 1).otherwise(n))
    # of sorted texts the first and the last have the fewest parts in common
    return ends.select("domain", F.array_join(F.filter(F.slice("x", F.lit(1), same), lambda p: F.lit(True)), "/").alias("base")).withColumn("base", F.regexp_replace("base", "/+$", ""))


def stripped(paths: DataFrame, path: str, home: str) -> DataFrame:
    """Adds base: the home folder if all paths of a domain lie in it, else an empty text."""
    p = paths.groupBy("domain").agg(common_prefix(F.col(path), home).alias("base"))
    return buckets.null_safe_join(paths, p, ["domain"])


def file_rows(index, dialect: str, home: str) -> DataFrame:
    """Rows of files, groups, their cards and folders. Markdown: below the folder all share, files before folders. Map: below home; files first at the top, behind folders below it."""
    fs, groups = index.kept("file_system"), index.groups
    files = fs.select("domain", F.col("file_path").alias("p"), F.lit(None).cast("string").alias("note"), F.array().cast("array<struct<label:string,path:string,essence:string>>").alias("cards"))
    held = groups.select("domain", F.col("source_path").alias("p"), F.col("annotation").alias("note"), F.filter("cards", lambda c: ~c["path"].eqNullSafe(F.col("hidden_card"))).alias("cards"))
    entry = held.unionByName(buckets.null_safe_join(files, held.select("domain", "p"), ["domain", "p"], "left_anti"))
    if dialect == "markdown":
        entry = buckets.null_safe_join(entry, base_folder(index), ["domain"])
    else:
        entry = stripped(entry, "p", home)
    rel = F.when((F.col("base") != "") & F.col("p").startswith(F.concat("base", F.lit("/"))), F.substr("p", F.length("base") + 2)).otherwise(F.regexp_replace("p", "^/", ""))
    parts = F.split(rel, "/")
    entry = entry.withColumn("parts", parts).withColumn("up", F.slice("parts", F.lit(1), F.size("parts") - 1))
    # 0 before 1: what stands first at a level
    file_rank = F.lit(0) if dialect == "markdown" else F.when(F.size("up") == 0, 0).otherwise(2)
    folder = lambda xs: F.transform(xs, lambda x: key(1, x))
    at = F.concat(folder(F.col("up")), F.array(key(file_rank, F.element_at("parts", -1), F.col("p"))))
    entry = cut(entry.withColumn("path", at))
    own = entry.select(*row(F.col("path"), F.element_at("parts", -1), F.col("p"), F.col("note")))
    below = entry.select("domain", "path", F.explode("cards").alias("c")).select(*row(F.concat("path", F.array(key(0, F.lower(F.col("c.label")), F.col("c.path")))), F.col("c.label"), F.col("c.path"), F.col("c.essence") if dialect == "map" else None))
    dirs = entry.select("domain", "base", "up", F.explode(F.when(F.size("up") > 0, F.sequence(F.lit(1), F.size("up")))).alias("k")).select("domain", F.slice("up", F.lit(1), F.col("k")).alias("d"), "base").distinct()
    notes = index.kept("dir_annotations").select(F.col("domain").alias("_d"), F.col("dir").alias("_p"), "essence")
    full = F.concat("base", F.lit("/"), F.array_join("d", "/"))
    dirs = dirs.withColumn("full", full).join(notes, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("full") == F.col("_p")), "left")
    name = F.element_at("d", -1)
    return own.unionByName(below).unionByName(dirs.select(*row(folder(F.col("d")), F.concat(name, F.lit("/")) if dialect == "markdown" else name, None, F.col("essence"))))


# --- the other views


def card_parts(index) -> tuple[DataFrame, DataFrame]:
    """(file_path, essence) and (file_path, source) of cards in groups."""
    c = index.groups.select("domain", "source_path", F.explode("cards").alias("c"))
    return c.filter("c.essence <> ''").select("domain", F.col("c.path").alias("file_path"), F.col("c.essence").alias("essence")), c.select("domain", F.col("c.path").alias("file_path"), "source_path")


def with_files(items: DataFrame, index, home: str) -> DataFrame:
    """items: domain, path (of the entry above), file_path. Adds essence, shown and a path with the buckets of a long list."""
    essence, _ = card_parts(index)
    e = essence.select(F.col("domain").alias("_d"), F.col("file_path").alias("_f"), "essence").dropDuplicates(["_d", "_f"])
    files = items.join(e, F.col("domain").eqNullSafe(F.col("_d")) & (F.col("file_path") == F.col("_f")), "left").drop("_d", "_f").withColumn("shown", display_path(F.col("file_path"), home))
    files = buckets.file_path_buckets(files, ["domain", "path"], "shown", "file_path").withColumn("above", F.col("path"))
    own = key(0, F.lower(base_name(F.col("file_path"))), F.col("file_path"))
    return cut(files.withColumn("path", F.concat("above", bucket_keys(), F.array(own))))


def fragments(items: DataFrame, files: DataFrame, index, home: str) -> DataFrame:
    """Below a card its source; below other files their places. items: domain, above, file_path, order (array of keys), text, link."""
    _, source = card_parts(index)
    of_cards = files.filter(F.col("file_path").endswith(".kb.md"))
    below = buckets.null_safe_join(of_cards, source, ["domain", "file_path"]).select("domain", "path", "source_path").select(*row(F.concat("path", F.array(key(0, F.col("source_path")))), display_path(F.col("source_path"), home), F.col("source_path")))
    place = items.join(files.select(F.col("domain").alias("_d"), F.col("above").alias("_a"), F.col("file_path").alias("_f"), F.col("path").alias("_p")), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("above") == F.col("_a")) & (F.col("file_path") == F.col("_f")))
    return below.unionByName(place.select(*row(F.concat("_p", F.array("order")), F.col("text"), F.col("link"))))


def keyword_rows(index, dialect: str, home: str) -> DataFrame:
    """The keyword files' trees with each leaf's files: in Markdown in the files' order, in a map by name, long lists in buckets, with places inside the files."""
    kw, hits = index.kept("keyword_entries"), index.kept("keyword")
    step = lambda x: key(1, x["key"]) if dialect == "markdown" else key(1, F.lower(x["text"]), x["key"])
    kw = kw.withColumn("path", F.transform("chain", step).cast(f"array<{KEY}>"))
    if dialect == "map":
        top = kw.select("domain", F.slice("path", 1, 1).alias("top"), F.get("chain", F.lit(0))["text"].alias("text")).distinct()
        top = buckets.letter_path(top, ["domain"], "text").select(F.col("domain").alias("_d"), F.col("top").alias("_t"), bucket_keys().alias("keys"), "buckets")
        kw = kw.join(top, F.col("domain").eqNullSafe(F.col("_d")) & (F.slice("path", 1, 1) == F.col("_t"))).withColumn("path", F.concat("keys", "path"))
    kw = cut(kw)
    out = kw.select(*row(F.col("path"), F.col("text")))
    if dialect == "map":
        out = out.unionByName(bucket_rows(kw, 0))
    h = cut(hits.filter("file_path is not null").withColumnRenamed("domain", "_d").join(kw.select("domain", F.col("kw_file").alias("_k"), F.col("pre").alias("_n"), "path"), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("kw_file") == F.col("_k")) & (F.col("kw_pre") == F.col("_n"))))
    one = h.select("domain", "path", "file_path").distinct()
    if dialect == "markdown":
        return out.unionByName(one.select(*row(F.concat("path", F.array(key(0, F.col("file_path")))), base_name(F.col("file_path")), F.col("file_path"))))
    files = with_files(one, index, home)
    out = out.unionByName(files.select(*row(F.col("path"), F.col("shown"), F.col("file_path"), F.col("essence")))).unionByName(file_bucket_rows(files))
    text = F.coalesce(F.nullif("text", F.lit("")), F.col("matched"))
    in_text = keywords.by_heading(h.filter("ftype = 'markdown'").select("domain", "path", "file_path", "pre", "node_id", "text", "matched"), index.nodes, ["domain", "path"])
    order = key(F.when(F.col("anchor").isNull(), 1).otherwise(0), F.lpad(F.col("pre").cast("string"), 12, "0"))
    a = in_text.select("domain", F.col("path").alias("above"), "file_path", order.alias("order"), F.when(F.col("anchor").isNotNull(), F.coalesce("heading_text", "anchor")).otherwise(shortened(text)).alias("text"), F.when(F.col("anchor").isNotNull(), F.concat("file_path", F.lit("#"), "anchor")).otherwise(F.col("file_path")).alias("link"))
    m = h.filter("ftype not in ('markdown', 'card')")
    b = m.select("domain", F.col("path").alias("above"), "file_path", key(0, F.lpad(F.col("pre").cast("string"), 12, "0")).alias("order"), shortened(text).alias("text"), relative_link(F.col("file_path"), "", F.col("node_id")).alias("link"))
    return out.unionByName(fragments(a.unionByName(b), files, index, home))


def file_bucket_rows(files: DataFrame) -> DataFrame:
    b = files.filter(F.size("buckets") > 0).select("domain", "above", "path", "buckets", F.explode(F.sequence(F.lit(1), F.size("buckets"))).alias("k"))
    return b.select(*row(F.slice("path", F.lit(1), F.size("above") + F.col("k")), F.element_at("buckets", F.col("k"))["a"])).distinct()


def tag_rows(index, dialect: str, home: str) -> DataFrame:
    """Tags in any case's order, each with its files, and in a map the places that have it."""
    t = index.kept("tag")
    tags = t.select("domain", "tag").distinct()
    own = key(1, F.lower("tag"), F.col("tag"))
    if dialect == "markdown":
        f = t.groupBy("domain", "tag", "file_path").agg(F.min_by("label", F.struct("node_id", "label")).alias("label"))
        return tags.select(*row(F.array(own), F.col("tag"))).unionByName(f.select(*row(F.array(own, key(0, F.col("file_path"))), F.coalesce(F.nullif("label", F.lit("")), base_name(F.col("file_path"))), F.col("file_path"))))
    tags = cut(buckets.letter_path(tags, ["domain"], "tag").withColumn("path", F.concat(bucket_keys(), F.array(own))))
    j = t.join(tags.select(F.col("domain").alias("_d"), F.col("tag").alias("_t"), "path"), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")))
    files = with_files(j.select("domain", "path", "file_path").distinct(), index, home)
    place = j.filter("node_id <> '' and not endswith(file_path, '.kb.md')").select("domain", F.col("path").alias("above"), "file_path", key(0, F.lower("label"), F.col("node_id")).alias("order"), F.col("label").alias("text"), F.concat("file_path", F.lit("#"), "node_id").alias("link"))
    out = tags.select(*row(F.col("path"), F.col("tag"))).unionByName(bucket_rows(tags, 0)).unionByName(file_bucket_rows(files))
    return out.unionByName(files.select(*row(F.col("path"), F.col("shown"), F.col("file_path"), F.col("essence")))).unionByName(fragments(place, files, index, home))


def word_rows(index, dialect: str, home: str) -> DataFrame:
    """Words with their files; in a map below groups of at most about 24, with the places in the files."""
    w = index.kept("word")
    own = key(1, F.lower("word"), F.col("word"))
    one = w.select("domain", "word", "file_path").distinct()
    if dialect == "markdown":
        return w.select("domain", "word").distinct().select(*row(F.array(own), F.col("word"))).unionByName(one.select(*row(F.array(own, key(0, F.col("file_path"))), base_name(F.col("file_path")), F.col("file_path"))))
    groups = cut(words.word_groups(w.select("domain", "word"), by="domain").withColumnRenamed("path", "labels").withColumn("path", F.concat(F.transform("labels", lambda x: key(1, x)), F.array(own))))
    above = groups.select("domain", "path", "labels", F.explode(F.when(F.size("labels") > 0, F.sequence(F.lit(1), F.size("labels")))).alias("k")).select(*row(F.slice("path", F.lit(1), F.col("k")), F.element_at("labels", F.col("k")))).distinct()
    j = w.join(groups.select(F.col("domain").alias("_d"), F.col("word").alias("_w"), "path"), F.col("domain").eqNullSafe(F.col("_d")) & (F.col("word") == F.col("_w")))
    essence, _ = card_parts(index)
    e = essence.select(F.col("domain").alias("_d2"), F.col("file_path").alias("_f2"), "essence").dropDuplicates(["_d2", "_f2"])
    f = j.select("domain", "path", "file_path").distinct().join(e, F.col("domain").eqNullSafe(F.col("_d2")) & (F.col("file_path") == F.col("_f2")), "left").withColumn("above", F.col("path")).withColumn("path", F.concat("path", F.array(key(0, F.lower(base_name(F.col("file_path"))), F.col("file_path")))))
    n = index.nodes.select(F.col("file_path").alias("_f"), F.col("pre").alias("_p"), "node_id", F.col("text").alias("node_text"))
    place = j.join(n, (F.col("file_path") == F.col("_f")) & (F.col("pre") == F.col("_p"))).filter("not endswith(file_path, '.kb.md')")
    place = place.select("domain", F.col("path").alias("above"), "file_path", key(0, F.lower("node_text"), F.lpad(F.col("pre").cast("string"), 12, "0")).alias("order"), shortened(F.col("node_text")).alias("text"), F.when(F.col("file_path").endswith(".mm"), F.concat("file_path", F.lit("#"), "node_id")).otherwise(F.col("file_path")).alias("link")).distinct()
    out = groups.select(*row(F.col("path"), F.col("word"))).unionByName(above)
    return out.unionByName(f.select(*row(F.col("path"), display_path(F.col("file_path"), home), F.col("file_path"), F.col("essence")))).unionByName(fragments(place, f, index, home))


def dependency_rows(index, dialect: str, home: str) -> DataFrame:
    d = index.kept("dependencies")
    own = key(1, F.lower("src_title"), F.col("src_path"))
    top = d.select("domain", "src_title", "src_path").distinct().select(*row(F.array(own), F.coalesce(F.nullif("src_title", F.lit("")), base_name(F.col("src_path"))), F.col("src_path")))
    at = F.array(own, key(F.col("pos"), F.col("tgt_label"), F.col("tgt_path")))
    below = row(at, F.col("tgt_label"), F.col("tgt_path")) if dialect == "markdown" else row(at, F.concat(F.lit("builds on: "), "tgt_label"), F.col("tgt_path"))
    return top.unionByName(d.select(*below))


def glossary_rows(index, dialect: str, home: str) -> DataFrame:
    g = index.kept("glossary")
    title = F.coalesce(F.nullif("title", F.lit("")), base_name(F.col("file_path")))
    at = F.array(key(1, F.lower("term"), F.col("term")))
    return g.select(*(row(at, title, F.col("file_path"), F.col("term")) if dialect == "markdown" else row(at, F.concat("term", F.lit(" — "), F.coalesce("title", F.lit(""))), F.col("file_path"))))


ROWS = {"file_system": file_rows, "keyword": keyword_rows, "tag": tag_rows, "word": word_rows, "dependencies": dependency_rows, "glossary": glossary_rows}


def outline(index, dialect: str, home: str) -> DataFrame:
    """All views that are turned on: view (its place in ORDER) and ROW. A view's own title is no row here."""
    out = None
    for i, name in enumerate(ORDER):
        if index.config.view_enabled(name):
            one = ROWS[name](index, dialect, home).select(F.lit(i).alias("view"), *ROW)
            out = one if out is None else out.unionByName(one)
    return cut(out)


# --- Markdown


def markdown_lines(index, home: str) -> DataFrame:
    """domain, view, path, line: an item each, a tab a level; views' titles and the base folder before them. A line holds no line end."""
    o = outline(index, "markdown", home)
    one = lambda c: F.regexp_replace(c, r"\s*\n\s*", " ")
    shown = F.when(F.col("link").isNotNull(), markdown_link(one("text"), F.col("link"))).otherwise(one("text"))
    pre = F.when((F.col("view") == ORDER.index("dependencies")) & (F.size("path") == 2), F.lit("builds on: ")).when(F.col("view") == ORDER.index("glossary"), F.concat(one("note"), F.lit(" → "))).otherwise("")
    post = F.when((F.col("view") == ORDER.index("file_system")) & F.col("note").isNotNull(), F.concat(F.lit(" — "), one("note"))).otherwise("")
    items = o.select("domain", "view", "path", F.concat(F.repeat(F.lit("\t"), F.size("path") - 1), F.lit("- "), pre, shown, post).alias("line"))
    views = o.select("domain", "view").distinct()
    title = F.element_at(F.array(*(F.lit(f"## {TITLES[n]}") for n in ORDER)), F.col("view") + 1)
    heads = views.select("domain", "view", F.explode(F.array(F.struct(F.lit(-4).alias("r"), F.lit("").alias("line")), F.struct(F.lit(-3).alias("r"), title.alias("line")), F.struct(F.lit(-2).alias("r"), F.lit("").alias("line")))).alias("h"))
    out = items.unionByName(heads.select("domain", "view", F.array(key(F.col("h.r"), F.lit(""))).cast(f"array<{KEY}>").alias("path"), "h.line"))
    if index.config.view_enabled("file_system"):
        out = out.unionByName(base_folder(index).select("domain", F.lit(0).alias("view"), F.array(key(-1, F.lit(""))).cast(f"array<{KEY}>").alias("path"), F.concat(F.lit("Base: `"), "base", F.lit("`\n")).alias("line")))
    return out


def to_markdown(index: KnowledgeIndex, folder: str, home: str | None = None) -> list[str]:
    """INDEX.md, and with domains a file for each, whose lines INDEX.md then lists; returns paths. All files' lines are sorted and written by one job."""
    spark, home = index.files.sparkSession, home or os.path.expanduser("~")
    os.makedirs(folder, exist_ok=True)
    names = [(r.domain, r.slug, r.n) for r in index.file_domains.groupBy("domain").agg(F.count("*").alias("n")).select("*", domain_slug(F.coalesce("domain", F.lit("index"))).alias("slug")).collect()]
    names.sort(key=lambda x: (x[0] is None, x[0] == "none", (x[0] or "").lower(), x[0] or ""))
    work = f"file://{os.path.abspath(folder)}/.lines"
    head = lambda title: f"{marker()}\n\n# Index of files: {title}\n\n> Made from the indexed files: keys and the places of files, not their contents. Made anew each time, so changes here are lost.\n"
    slug = F.when(F.col("domain").isNull(), "INDEX").otherwise(domain_slug(F.col("domain")))
    rows = markdown_lines(index, home).select(slug.alias("slug"), "domain", "view", "path", "line")
    rows.repartition("slug").sortWithinPartitions("slug", "domain", "view", "path", "line").select("slug", F.col("line").alias("value")).write.mode("overwrite").partitionBy("slug").text(work)
    out, seen = [], set()
    for domain, slug, _ in names:
        name = "INDEX" if domain is None else slug
        if name in seen:
            continue
        seen.add(name)
        out.append(os.path.join(folder, f"{name}.md"))
        joined(spark, f"{work}/slug={name}", out[-1], head("Index" if domain is None else domain))
    if names and names[0][0] is not None:
        out.append(os.path.join(folder, "INDEX.md"))
        with open(out[-1], "w", encoding="utf-8") as f:
            f.write(head("Domains") + "\n" + "".join(f"- [{d}]({s}.md) — {n} file(s)\n" for d, s, n in names))
    remove(spark, work)
    return out


def joined(spark, source: str, target: str, head: str = "", tail: str = "") -> None:
    """A folder's part files in order as one local file: bytes are copied, never held."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(source)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    with open(target, "w", encoding="utf-8") as f:
        f.write(head)
    if fs.exists(where):
        sink = jvm.java.io.FileOutputStream(target, True)
        for p in sorted(s.getPath().toString() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")):
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 1 << 16, False)
            stream.close()
        sink.close()
    if tail:
        with open(target, "a", encoding="utf-8") as f:
            f.write(tail)


def remove(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


# --- mind maps


def xml(text: Column) -> Column:
    """Text as the value of an attribute; characters that XML has no place for are left out."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def map_rows(index: KnowledgeIndex, home: str) -> DataFrame:
    """Rows of the whole map, title nodes among them: path (with a section and a view before the view's own), text, link, note.

    With several domains all views come for all domains together first, then a branch for each; with one domain there is its branch; without any the views.
    """
    found = sorted({r.domain for r in index.file_domains.select("domain").distinct().collect()}, key=lambda d: (d is None, d == "none", (d or "").lower(), d or ""))
    real = [d for d in found if d is not None]
    sections = [(Merged(index), None, [])] if len(real) > 1 else []
    if len(real) > 1:
        sections += [(index, real, [(99, "Domains", "")])]
    else:
        sections += [(index, real or [None], [])]
    out = None
    for source, wanted, above in sections:
        o = outline(source, "map", home)
        if wanted is not None:
            fits = F.lit(False)
            for d in wanted:
                fits = fits | F.col("domain").eqNullSafe(F.lit(d).cast("string"))
            o = o.filter(fits)
        up = [key(r, F.lit(a), F.lit(b)) for r, a, b in above]
        own = [key(F.when(F.col("domain") == "none", 1).otherwise(0), F.lower("domain"), F.col("domain"))] if wanted and wanted != [None] else []
        view = key(F.col("view"), F.lit(""))
        title = F.element_at(F.array(*(F.lit(TITLES[n]) for n in ORDER)), F.col("view") + 1)
        parts = [o.select(F.concat(F.array(*up, *own, view), "path").cast(f"array<{KEY}>").alias("path"), "text", "link", "note")]
        null = F.lit(None).cast("string")
        parts.append(o.select("domain", "view").distinct().select(F.array(*up, *own, view).cast(f"array<{KEY}>").alias("path"), title.alias("text"), null.alias("link"), null.alias("note")))
        if own:
            parts.append(o.select("domain").distinct().select(F.array(*up, *own).cast(f"array<{KEY}>").alias("path"), F.concat(F.lit("Domain: "), "domain").alias("text"), null.alias("link"), null.alias("note")))
        if above:
            parts.append(index.files.sparkSession.range(1).select(F.array(*up).cast(f"array<{KEY}>").alias("path"), F.lit(above[0][1]).alias("text"), null.alias("link"), null.alias("note")))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def map_lines(rows: DataFrame, base: str, stamp: str) -> DataFrame:
    """part, path, line: a node's opening tag and details, then as many closing tags as the next row needs. part is the first level's, so that branches are written apart."""
    link = F.when(F.col("link").isNotNull(), F.concat(F.lit(' LINK="'), xml(relative_link(F.col("link"), base)), F.lit('"'))).otherwise("")
    details = F.when(F.col("note").isNotNull(), F.concat(F.lit('<richcontent TYPE="DETAILS" HIDDEN="true"><html><head/><body><p>'), xml("note"), F.lit("</p></body></html></richcontent>"))).otherwise("")
    opened = F.concat(F.lit('<node ID="ID_'), F.lower(F.hex(F.xxhash64("path", "text"))), F.lit(f'" CREATED="{stamp}" MODIFIED="{stamp}" TEXT="'), xml(F.coalesce("text", F.lit(""))), F.lit('"'), link, F.lit(">"), details)
    top = F.slice("path", 1, F.when(F.get("path", F.lit(0))["a"] == "Domains", 2).otherwise(1))
    p = rows.withColumn("part", top).withColumn("open", opened)
    following = F.lead(F.size("path")).over(Window.partitionBy("part").orderBy("path", "text", "open"))
    # the last row of a part closes up to its top; a part of one row above others leaves its node open for them
    floor = F.when((F.size("part") == 1) & (F.get("path", F.lit(0))["a"] == "Domains"), 2).otherwise(F.size("part"))
    return p.select("part", "path", F.concat("open", F.repeat(F.lit("</node>"), F.greatest(F.size("path") - F.coalesce(following, floor) + 1, F.lit(0)))).alias("line"), "open")


def to_mindmap(index: KnowledgeIndex, path: str, home: str | None = None, base: str | None = None) -> None:
    """One map; links are relative to `base` (the working folder) where they can be."""
    spark, home, base = index.files.sparkSession, home or os.path.expanduser("~"), base or os.getcwd()
    stamp = str(int(datetime.now(timezone.utc).timestamp() * 1000))
    rows = cut(map_rows(index, home))
    lines = map_lines(rows, base, stamp)
    work = f"file://{os.path.abspath(path)}.lines"
    lines.orderBy("path", "open").select(F.col("line").alias("value")).write.mode("overwrite").text(work)
    many = rows.filter((F.size("path") == 1) & (F.col("text") == "Domains") & (F.get("path", F.lit(0))["a"] == "Domains")).count()
    joined(spark, work, path, f'<map version="1.0.1">\n{marker()}\n<node ID="ID_0" CREATED="{stamp}" MODIFIED="{stamp}" TEXT="Navigation Index">\n', "</node>\n" * (1 + many) + "</map>\n")
    remove(spark, work)


def to_tables(index: KnowledgeIndex, folder: str) -> list[str]:
    """Each view that is turned on as a Parquet table, a folder for each domain (the null one for files outside all); returns paths."""
    out = []
    for name in ORDER:
        if (view := index.view(name)) is not None:
            out.append(f"{folder}/{name}")
            view.write.mode("overwrite").partitionBy("domain").parquet(out[-1])
    return out


def to_map_of(views: dict[str, DataFrame], path: str, stamp: str = "0") -> None:
    """A map from a caller's own relations, without an index: titles in order, each with rows of ROW."""
    out, null = None, F.lit(None).cast("string")
    for i, (title, rows) in enumerate(views.items()):
        at = F.array(key(i, F.lit(title))).cast(f"array<{KEY}>")
        one = rows.select(F.concat(at, F.col("path").cast(f"array<{KEY}>")).alias("path"), "text", "link", "note").unionByName(rows.sparkSession.range(1).select(at.alias("path"), F.lit(title).alias("text"), null.alias("link"), null.alias("note")))
        out = one if out is None else out.unionByName(one)
    spark = out.sparkSession
    work = f"file://{os.path.abspath(path)}.lines"
    map_lines(out, os.getcwd(), stamp).orderBy("path", "open").select(F.col("line").alias("value")).write.mode("overwrite").text(work)
    joined(spark, work, path, f'<map version="1.0.1">\n{marker()}\n<node ID="ID_0" CREATED="{stamp}" MODIFIED="{stamp}" TEXT="Navigation Index">\n', "</node>\n</map>\n")
    remove(spark, work)
