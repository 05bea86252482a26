"""Every operator as a query over the driver's tables, with the SQL that gives the same rows.

The tables hold no document trees, so both sides derive them by one rule: a document is a file whose lines are nodes, the first at level 1, any other at 1
plus the rest of its length by 3; every fourth file is a card, whose fields follow from its id. Regions, nations and customers are a tree of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from treedex.config import Config
from treedex.functions import text as T
from treedex.operators import buckets, cards, domains, keywords, markdown, search, stale, tree, words
from treedex.plans import index as plan, render
from treedex.plans.lineage import shared
from treedex.plans.store import ViewStore
from treedex.sources import files as source, mindmap
from treedex.timing import Counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 4 == 0, ".kb.md").when(F.col("doc_id") % 4 == 1, ".mm").when(F.col("doc_id") % 4 == 2, ".md").otherwise(".markdown")
    path = F.concat(F.lit("/kb/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), ending)
    f = table(spark, d, "documents").select("doc_id", path.alias("file_path"), F.col("text").alias("content"), "lang", "source")
    return f.withColumns({"name": T.base_name(F.col("file_path")), "dir": T.parent_dir(F.col("file_path"))}).withColumn("ftype", T.file_type(F.col("name")))


FILES = """f AS (SELECT doc_id, '/kb/' || source || '/' || lang || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.kb.md' WHEN 1 THEN '.mm' WHEN 2 THEN '.md' ELSE '.markdown' END AS file_path,
    '/kb/' || source || '/' || lang AS dir, text AS content, lang, source, CASE doc_id % 4 WHEN 0 THEN 'card' WHEN 1 THEN 'freeplane' ELSE 'markdown' END AS ftype FROM documents)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    line = files(spark, d).select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    n = line.select("file_path", (F.col("i") + 1).cast("bigint").alias("pre"), "text", F.when(F.col("i") == 0, 1).otherwise(1 + F.length("text") % 3).cast("int").alias("level"))
    return tree.intervals(n, levels=3).withColumn("search_text", F.col("text"))


NODES = FILES + """,
    s AS (SELECT file_path, string_split(content, chr(10)) AS ls FROM f),
    l AS (SELECT file_path, i AS pre, ls[i] AS text, CASE WHEN i = 1 THEN 1 ELSE 1 + length(ls[i]) % 3 END::BIGINT AS level FROM (SELECT file_path, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
    n AS (SELECT *, CASE level WHEN 2 THEN max(CASE WHEN level = 1 THEN pre END) OVER b WHEN 3 THEN max(CASE WHEN level <= 2 THEN pre END) OVER b END AS parent_pre,
        coalesce(CASE level WHEN 1 THEN min(CASE WHEN level = 1 THEN pre END) OVER a WHEN 2 THEN min(CASE WHEN level <= 2 THEN pre END) OVER a ELSE min(pre) OVER a END - 1, max(pre) OVER (PARTITION BY file_path)) AS last,
        regexp_replace(lower(text), '[\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]', '0', 'g') AS plain
        FROM l WINDOW b AS (PARTITION BY file_path ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY file_path ORDER BY pre ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))"""


def _m(term: str) -> str:
    return rf"regexp_matches(plain, '\b(?:{term})\b')"


def _bag(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_path", "pre").agg(F.count("*").alias("hits"))


# --- sources and predicates


@query(f"WITH {FILES} SELECT ftype, count(*) AS n FROM f GROUP BY 1")
def type_classify(spark, d):
    return files(spark, d).groupBy("ftype").agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT file_path FROM f WHERE ftype IN ('card', 'markdown')")
def type_select(spark, d):
    return files(spark, d).filter(F.col("ftype").isin(T.selected_types(exclude=["freeplane"]))).select("file_path")


@query(f"WITH {FILES} SELECT file_path FROM f WHERE NOT (source IN ('src1', 'src3') OR file_path LIKE '/kb/src2/%.md')")
def exclude_prune(spark, d):
    return files(spark, d).filter(~T.excluded(F.col("file_path"), ["**/src1/**", "**/src3", "/kb/src2/*.md"])).select("file_path")


@query(f"WITH {FILES} SELECT file_path FROM f WHERE NOT contains(substr(content, 1, 4096), 'Licensed')")
def generated_skip(spark, d):
    return files(spark, d).filter(~T.is_generated(F.col("content"), "Licensed")).select("file_path")


@query("SELECT l_returnflag AS kind, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1")
def union_of_sources(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"))
    return a.unionByName(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n")))


# --- Markdown: a text's lines as they stand, some made headings and list items


def _marked(spark, d):
    """Lines numbered from 0, with signs and white space of many kinds around them; by 7 rest 5 a no-break space alone."""
    line = files(spark, d).filter("ftype <> 'freeplane'").select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "t"))
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("i") % len(x) + 1).cast("int"))
    heading = F.concat(pick("", "\t", "\xa0", "\x1c "), pick("#", "##", "###", "#######", "####"), pick(" ", "\xa0\t", ""), "t", pick("", "  ", " ", "\x85", "\r"))
    item = F.concat(pick("", "  ", "\t\t\xa0\xa0", " "), pick("-", "12.", "+", "*", "1"), pick(" ", "\t", "\xa0"), "t", pick("", " \t"))
    made = F.when(F.col("i") % 7 == 0, heading).when(F.col("i") % 7 == 3, item).when(F.col("i") % 7 == 5, F.lit("\xa0")).otherwise(F.col("t"))
    return line.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", made.alias("m")))), lambda x: x["m"]), "\n").alias("content"))


_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PICK = lambda *x: "[" + ", ".join(" || ".join(f"chr({ord(c)})" for c in v) or "''" for v in x) + f"][i % {len(x)} + 1]"
MARKED = FILES + f""",
    s AS (SELECT file_path, string_split(content, chr(10)) AS ls FROM f WHERE ftype <> 'freeplane'),
    u AS (SELECT file_path, i, ls[i + 1] AS t FROM (SELECT file_path, ls, unnest(range(0, len(ls))) AS i FROM s)),
    md AS (SELECT file_path, string_agg(CASE i % 7
        WHEN 0 THEN {_PICK("", chr(9), chr(0xA0), chr(0x1C) + " ")} || {_PICK("#", "##", "###", "#######", "####")} || {_PICK(" ", chr(0xA0) + chr(9), "")} || t || {_PICK("", "  ", chr(0x2003), chr(0x85), chr(13))}
        WHEN 3 THEN {_PICK("", "  ", chr(9) * 2 + chr(0xA0) * 2, " ")} || {_PICK("-", "12.", "+", "*", "1")} || {_PICK(" ", chr(9), chr(0xA0))} || t || {_PICK("", " " + chr(9))}
        WHEN 5 THEN chr(160) ELSE t END, chr(10) ORDER BY i) AS content FROM u GROUP BY 1),
    v AS (SELECT file_path, n::BIGINT AS line_number, regexp_replace(raw, '^{_W}+|{_W}+$', '', 'g') AS st, raw FROM (SELECT file_path, ls, unnest(range(1, len(ls) + 1)) AS n, unnest(ls) AS raw FROM (SELECT file_path, string_split_regex(content, '\\r\\n?|\\n') AS ls FROM md))),
    k AS (SELECT file_path, line_number, CASE WHEN h[1] <> '' THEN 'heading' WHEN l[2] <> '' THEN 'list_item' ELSE 'content' END AS kind,
        CASE WHEN h[1] <> '' THEN length(h[1]) WHEN l[2] <> '' THEN length(l[1]) // 2 ELSE 0 END::BIGINT AS level, CASE WHEN h[1] <> '' THEN h[2] WHEN l[2] <> '' THEN l[3] ELSE st END AS text
        FROM (SELECT file_path, line_number, st, [regexp_extract(st, '{{h}}', 1), regexp_extract(st, '{{h}}', 2)] AS h, [regexp_extract(raw, '{{l}}', 1), regexp_extract(raw, '{{l}}', 2), regexp_extract(raw, '{{l}}', 3)] AS l FROM v WHERE st <> ''))
    """.replace("{h}", rf"^(#{{1,6}}){_W}+(.+)$").replace("{l}", rf"^({_W}*)([-*+]|\p{{Nd}}+\.){_W}+(.+)$")  # fmt: skip


@query(f"WITH {MARKED} SELECT file_path, line_number, kind, level, md5(text) AS text_md5 FROM k")
def line_classify(spark, d):
    return markdown.lines(_marked(spark, d)).select("file_path", "line_number", "kind", F.col("level").cast("bigint"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {MARKED}, r AS (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_number) AS section FROM k)
    SELECT file_path, section::BIGINT AS section, min(line_number) AS line_number, md5(string_agg(text, ' ' ORDER BY line_number)) AS content_md5 FROM r WHERE section > 0 AND kind <> 'list_item' GROUP BY 1, 2""")
def section_content(spark, d):
    return markdown.sections(markdown.lines(_marked(spark, d))).select("file_path", "section", "line_number", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {MARKED}, m AS (SELECT file_path, line_number, kind, CASE WHEN kind = 'heading' THEN level ELSE 7 + level END AS lv, row_number() OVER (PARTITION BY file_path ORDER BY line_number) AS pre FROM k WHERE kind <> 'content')
    SELECT file_path, pre, kind AS node_type, (SELECT max(p.pre) FROM m p WHERE p.file_path = m.file_path AND p.pre < m.pre AND p.lv < m.lv) AS parent_pre FROM m""")
def markdown_tree(spark, d):
    return markdown.nodes(_marked(spark, d)).select("file_path", "pre", "node_type", "parent_pre")


@query(f"""WITH {MARKED}, m AS (SELECT file_path, line_number, kind, CASE WHEN kind = 'heading' THEN level ELSE 7 + level END AS lv, row_number() OVER (PARTITION BY file_path ORDER BY kind <> 'heading', line_number) AS pre FROM k WHERE kind <> 'content')
    SELECT file_path, pre, kind AS node_type, (SELECT max(p.pre) FROM m p WHERE p.file_path = m.file_path AND p.pre < m.pre AND p.lv < m.lv) AS parent_pre FROM m""")
def markdown_tree_compat(spark, d):
    return markdown.nodes(_marked(spark, d), order="compat").select("file_path", "pre", "node_type", "parent_pre")


@query(f"""WITH {MARKED} SELECT f.file_path, count(*) FILTER (WHERE kind <> 'content') + max(CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END) AS n, max(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS n_tags
    FROM f LEFT JOIN k ON k.file_path = f.file_path WHERE ftype <> 'freeplane' AND doc_id % 7 <> 0 GROUP BY 1 HAVING n > 0""")
def incremental_views(spark, d):
    """Nodes and tags by file as tables hold them after three batches: most files; the rest, and every fifth changed; every seventh deleted."""
    f = _marked(spark, d).join(files(spark, d).select("file_path", "doc_id", "dir", "name", "ftype"), "file_path").withColumns({"length": F.length("content").cast("bigint"), "mtime_ns": F.col("doc_id"), "root": F.lit("/kb")})
    changed = f.withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit("\n# added #newtag\n- item"))).otherwise(F.col("content")))
    kept = ViewStore(spark, f"{shared(spark)}/views-{uuid.uuid4().hex}")
    kept.update(f.filter("doc_id % 3 <> 0"))
    kept.update(changed.filter("doc_id % 3 = 0 OR doc_id % 5 = 0"))
    kept.update(changed.limit(0), changed.filter("doc_id % 7 = 0").select("file_path"))
    new = F.count_if((F.col("tag") == "newtag") & (F.col("node_id") == ""))
    tags = kept.table("tags").groupBy("file_path").agg(new.cast("int").alias("t"))
    n = kept.table("nodes").groupBy("file_path").agg(F.count("*").alias("n"))
    return n.join(tags, "file_path", "left").select("file_path", "n", F.coalesce("t", F.lit(0)).alias("n_tags"))


# --- trees


@query(f"WITH {NODES} SELECT file_path, pre, level, parent_pre FROM n")
def tree_parent(spark, d):
    return nodes(spark, d).select("file_path", "pre", F.col("level").cast("bigint"), "parent_pre")


@query(f"WITH {NODES} SELECT file_path, pre, last FROM n")
def tree_interval(spark, d):
    return nodes(spark, d).select("file_path", "pre", "last")


@query(f"WITH {NODES} SELECT n.file_path, n.pre, count(*) AS depth, string_agg(p.pre::VARCHAR, '/' ORDER BY p.pre) AS path FROM n JOIN n p ON p.file_path = n.file_path AND n.pre BETWEEN p.pre AND p.last GROUP BY 1, 2")
def tree_depth_path(spark, d):
    n = tree.depth_and_path(nodes(spark, d).withColumn("name", F.col("pre").cast("string")), text="name", levels=3)
    return n.select("file_path", "pre", "depth", F.array_join("path", "/").alias("path"))


@query(f"WITH {NODES} SELECT p.file_path, p.pre, count(*) AS n FROM n JOIN n p ON p.file_path = n.file_path AND n.pre > p.pre AND n.pre <= p.last GROUP BY 1, 2")
def descendant_counts(spark, d):
    return tree.descendant_counts(nodes(spark, d))


def _geo(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.lit(-1).alias("n"), F.lit(-1).cast("bigint").alias("c"), F.lit(1).alias("level"), F.col("r_name").alias("text"))
    n = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.lit(-1).cast("bigint"), F.lit(2), "n_name")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "c_custkey", F.lit(3), "c_name")
    # a tree's order within its region; regions are the files
    every = r.union(n).union(c).withColumn("file_path", F.col("r").cast("string")).withColumn("pre", (F.col("n") + 1) * 10_000_000 + F.col("c") + 1)
    return tree.intervals(every, levels=3)


@query("""SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey < 10) GROUP BY 1""")
def geo_subtree(spark, d):
    g = _geo(spark, d)
    below = tree.descendants(g, (F.col("level") == 2) & (F.col("n") < 10))
    names = g.filter("level = 1").select("file_path", F.col("text").alias("region"))
    return below.filter("level = 3").groupBy("file_path").agg(F.count("*").alias("n")).join(names, "file_path").select("region", "n")


@query(f"WITH {NODES} SELECT file_path, parent_pre AS pre, count(*) AS n FROM n WHERE parent_pre = 1 AND level = 3 GROUP BY 1, 2")
def children_by_type(spark, d):
    n = nodes(spark, d).withColumn("node_type", F.col("level").cast("string"))
    return tree.children(n, F.lit(1), "3").groupBy("file_path", F.col("parent_pre").alias("pre")).agg(F.count("*").alias("n"))


@query(f"""WITH {NODES}, h AS (SELECT * FROM n WHERE {_m('with')})
    SELECT h.file_path, h.pre, max(p.pre) AS heading_pre FROM h JOIN n p ON p.file_path = h.file_path AND h.pre BETWEEN p.pre AND p.last AND p.level <= 2 GROUP BY 1, 2""")
def nearest_heading(spark, d):
    n = nodes(spark, d).withColumn("node_type", F.when(F.col("level") <= 2, "heading").otherwise("list_item"))
    found = search.search_sequence(n, ["with"]).select("file_path", "pre")
    return tree.nearest_heading(n, found, levels=2).select("file_path", "pre", "heading_pre")


# --- search


@query(f"WITH {NODES} SELECT file_path, pre, 1::BIGINT AS hits FROM n WHERE {_m('by|with')}")
def search_one(spark, d):
    return _bag(search.search_sequence(nodes(spark, d), ["by|with"]))


@query(f"""WITH {NODES}, a AS (SELECT file_path, pre, last FROM n WHERE {_m('the')})
    SELECT n.file_path, n.pre, count(*) AS hits FROM a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('with')} GROUP BY 1, 2""")
def search_two(spark, d):
    return _bag(search.search_sequence(nodes(spark, d), ["the", "with"]))


@query(f"""WITH {NODES}, a AS (SELECT file_path, pre, last, row_number() OVER () AS m FROM n WHERE {_m('the')}),
    b AS (SELECT m, arg_min(n, n.pre) AS x FROM a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('of')} GROUP BY m)
    SELECT n.file_path, n.pre, count(*) AS hits FROM b JOIN n ON n.file_path = b.x.file_path AND n.pre BETWEEN b.x.pre AND b.x.last WHERE {_m('with')} GROUP BY 1, 2""")
def search_three(spark, d):
    return _bag(search.search_sequence(nodes(spark, d), ["the", "of", "with"]))


_MANY = "SELECT '{0}:{1}' AS sequence, count(*) AS hits FROM (SELECT file_path, pre, last FROM n WHERE {2}) a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {3}"


@query(f"WITH {NODES}, r AS (" + " UNION ALL ".join(_MANY.format(a, b, _m(a), _m(b)) for a, b in (("the", "by"), ("der", "mit"), ("la", "para"), ("nosuchword", "the"))) + ") SELECT * FROM r WHERE hits > 0")
def search_many(spark, d):
    return search.search_counts(nodes(spark, d), [["the", "by"], ["der", "mit"], ["la", "para"], ["nosuchword", "the"]]).groupBy("sequence").agg(F.sum("times").alias("hits"))


@query(rf"""WITH {NODES}, leaves AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
    tok AS (SELECT DISTINCT file_path, pre, unnest(regexp_extract_all(plain, '[a-z0-9_]+')) AS w FROM n), a AS (SELECT file_path, pre, last FROM n WHERE {_m('the')})
    SELECT w AS sequence, count(*) AS hits FROM tok JOIN leaves USING (w) GROUP BY 1 UNION ALL SELECT 'the:' || w, count(*) FROM a JOIN tok b ON a.file_path = b.file_path AND b.pre BETWEEN a.pre AND a.last JOIN leaves USING (w) GROUP BY 1""")
def search_leaves(spark, d):
    """Every word of the benchmark's items as a leaf of its own and below another term."""
    words_ = sorted(r.w for r in table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).distinct().collect())
    return search.search_counts(nodes(spark, d), [[w] for w in words_] + [["the", w] for w in words_]).groupBy("sequence").agg(F.sum("times").alias("hits"))


#: Patterns of the configuration's dialect, and what the same asks for in SQL's.
_PATTERNS = [
    (r"(?P<first>t)he", "the"), (r"(?:with|mit)\.?\Z", r"(?:with|mit)\.?\z"), (r"(w)?(?(1)ith|the)", "with|the"), (r"th(?#a remark)e", "the"), (r"(?i:W)ith", "with"), (r"d(?P<x>e)[rs]", "de[rs]"),
    (r"\x74he", "the"), ("[]w[]ith", "with"), (r"\w{,3}en", r"\w{0,3}en"), (r"[\w-]+ing", r"[\w-]+ing"), ("(", None), (r"\p{L}e", None), ("(?P<a>x)(?P<a>y)", None), (r"and\s+the", r"and\s+the"),
]


@query(f"WITH {NODES}, r AS (" + " UNION ALL ".join(f"SELECT {i} AS number, count(*) AS hits FROM n WHERE {_m(q) if q else 'false'}" for i, (_, q) in enumerate(_PATTERNS)) + ") SELECT number::INTEGER AS number, hits FROM r WHERE hits > 0")
def search_patterns(spark, d):
    good = search.valid_patterns(spark, [p for p, _ in _PATTERNS])
    asked = [[p] for p, _ in _PATTERNS if good[p]]
    number = F.create_map(*(F.lit(x) for i, (p, _) in enumerate(_PATTERNS) for x in (p, i)))
    return search.search_counts(nodes(spark, d), asked).groupBy(number[F.col("sequence")].alias("number")).agg(F.sum("times").alias("hits"))


@query(f"""WITH {NODES}, a AS (SELECT file_path, pre, last FROM n WHERE {_m('the')})
    SELECT DISTINCT n.file_path, n.pre FROM a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('with')}""")
def search_dedup(spark, d):
    return search.dedup(search.search_sequence(nodes(spark, d), ["the", "with"])).select("file_path", "pre")


def _in_order(rows: DataFrame) -> DataFrame:
    """Sorted rows with their place, from 0: the order itself is compared, not what it was made from."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", place bigint"
    return rows.sparkSession.createDataFrame(rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


@query(f"WITH {NODES} SELECT file_path, pre, row_number() OVER (ORDER BY file_path, text, pre) - 1 AS place FROM n WHERE {_m('nicht')}")
def search_sorted(spark, d):
    return _in_order(search.sort_results(search.search_sequence(nodes(spark, d), ["nicht"])).select("file_path", "pre"))


@query(f"WITH {NODES} SELECT file_path, pre FROM n WHERE {_m('with')} AND (ends_with(file_path, '.mm') OR ends_with(file_path, '.kb.md'))")
def search_by_type(spark, d):
    return search.filter_by_type(search.search_sequence(nodes(spark, d), ["with"]), [".mm", ".kb.md"]).select("file_path", "pre")


@query("SELECT conv_id::VARCHAR AS file_path, turn AS pre FROM conversations WHERE regexp_matches(regexp_replace(lower(text), '[\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]', '0', 'g'), '\\b(?:the)\\b')")
def search_conversations(spark, d):
    n = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("pre"), F.col("turn").alias("last"), "text", F.col("text").alias("search_text"))
    return search.search_sequence(n, ["the"]).select("file_path", "pre")


# --- keywords

KEYWORDS = "Common\n\tthe:with\n\tmit\nRare\n\tnosuchword\n\tdes:para\nund\n"


@query(f"""WITH {NODES}, r AS (SELECT 'the:with' AS sequence, n.file_path, n.pre FROM (SELECT file_path, pre, last FROM n WHERE {_m('the')}) a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('with')}
    UNION ALL SELECT 'mit', file_path, pre FROM n WHERE {_m('mit')} UNION ALL SELECT 'und', file_path, pre FROM n WHERE {_m('und')} UNION ALL SELECT 'nosuchword', NULL, NULL UNION ALL
    SELECT 'des:para', n.file_path, n.pre FROM (SELECT file_path, pre, last FROM n WHERE {_m('des')}) a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('para')})
    SELECT k AS keyword, count(pre) AS hits, count(DISTINCT file_path) AS n_files FROM (VALUES ('the:with'), ('mit'), ('nosuchword'), ('des:para'), ('und')) v(k) LEFT JOIN r ON r.sequence = k GROUP BY 1""")
def keyword_leaf_empty(spark, d):
    found = keywords.search(nodes(spark, d), keywords.frame(spark, keywords.parse(KEYWORDS)))
    return found.groupBy("keyword").agg(F.count("pre").alias("hits"), F.count_distinct("file_path").alias("n_files"))


def _keyword_files(spark, d):
    """Each document as a keyword file: a line's first word, or two with a colon, on three levels by tabs and blanks; every fifth line a comment."""
    line = files(spark, d).select("file_path", F.posexplode(F.split("content", "\n")).alias("i", "t")).withColumn("w", F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0)))
    body = F.when((F.col("i") % 3 == 0) & (F.size("w") > 1), F.concat(F.get("w", F.lit(0)), F.lit(":"), F.get("w", F.lit(1)))).otherwise(F.coalesce(F.get("w", F.lit(0)), F.lit("")))
    indent = F.element_at(F.array(*map(F.lit, ("", "\t", "\t\t", "    "))), (F.col("i") % 4 + 1).cast("int"))
    made = F.when(F.col("i") % 5 == 4, F.lit("\t# remark")).otherwise(F.concat(indent, body))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", made.alias("m")))), lambda x: x["m"]), "\n")
    return line.groupBy(F.col("file_path").alias("kw_file")).agg(text.alias("content"))


KEYWORD_ROWS = FILES + """,
    s AS (SELECT file_path AS kw_file, string_split(content, chr(10)) AS ls FROM f),
    kl AS (SELECT kw_file, i, regexp_extract_all(ls[i + 1], '[A-Za-z]+') AS w FROM (SELECT kw_file, ls, unnest(range(0, len(ls))) AS i FROM s)),
    kb AS (SELECT kw_file, i, CASE i % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS level, CASE WHEN i % 3 = 0 AND len(w) > 1 THEN w[1] || ':' || w[2] ELSE w[1] END AS text FROM kl WHERE i % 5 <> 4 AND len(w) > 0),
    kr AS (SELECT *, row_number() OVER (PARTITION BY kw_file ORDER BY i) AS pre FROM kb),
    kt AS (SELECT *, CASE level WHEN 1 THEN max(CASE WHEN level = 0 THEN pre END) OVER b WHEN 2 THEN max(CASE WHEN level <= 1 THEN pre END) OVER b END AS parent_pre,
        coalesce(CASE level WHEN 0 THEN min(CASE WHEN level = 0 THEN pre END) OVER a WHEN 1 THEN min(CASE WHEN level <= 1 THEN pre END) OVER a ELSE min(pre) OVER a END - 1, max(pre) OVER (PARTITION BY kw_file)) AS last
        FROM kr WINDOW b AS (PARTITION BY kw_file ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY kw_file ORDER BY pre ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    ke AS (SELECT *, last = pre AS is_leaf, max(CASE WHEN parent_pre IS NULL THEN pre END) OVER (PARTITION BY kw_file ORDER BY pre ROWS UNBOUNDED PRECEDING) AS top FROM kt)"""


@query(f"WITH {KEYWORD_ROWS} SELECT ke.kw_file, CASE WHEN ke.top < ke.pre THEN t.text ELSE 'Direct Searches' END AS category, ke.text AS sequence FROM ke JOIN ke t ON t.kw_file = ke.kw_file AND t.pre = ke.top WHERE ke.is_leaf")
def keyword_categories(spark, d):
    return keywords.parsed(_keyword_files(spark, d)).filter("is_leaf").select("kw_file", "category", F.array_join("sequence", ":").alias("sequence"))


@query("""WITH d AS (SELECT DISTINCT lang AS domain FROM documents UNION ALL SELECT 'none' UNION ALL SELECT NULL), k(keyword, scope) AS (VALUES ('g', NULL), ('x', 'en'), ('y', 'de'))
    SELECT domain, keyword FROM d, k WHERE scope IS NULL OR domain IS NULL OR (domain <> 'none' AND domain = scope)""")
def keyword_scoped(spark, d):
    k = keywords.Keywords(keywords.parse("g").rows + keywords.parse("x", scope=["en"]).rows + keywords.parse("y", scope=["de"]).rows)
    doms = table(spark, d, "documents").select(F.col("lang").alias("domain")).distinct().unionByName(spark.createDataFrame([("none",), (None,)], "domain string"))
    return keywords.scoped(keywords.frame(spark, k), doms).select("domain", F.col("text").alias("keyword"))


# --- domains


def _areas(spark, d):
    f = files(spark, d).select("source", "lang").distinct()
    return f.select(F.concat(F.lit("/kb/"), "source").alias("dir"), F.when(~F.col("source").endswith("7"), F.col("source")).alias("domain")).distinct().unionByName(f.filter("lang = 'fr'").select(F.concat(F.lit("/kb/"), "source", F.lit("/fr")).alias("dir"), F.lit("french").alias("domain")).distinct())


DOMAINS = FILES + ", fd AS (SELECT file_path, ftype, CASE WHEN ftype = 'card' THEN lang WHEN lang = 'fr' THEN 'french' WHEN source LIKE '%7' THEN NULL ELSE source END AS domain FROM f)"


def _file_domains(spark, d):
    f = files(spark, d)
    return domains.resolved(f.select("file_path"), _areas(spark, d), f.filter("ftype = 'card'").select("file_path", F.col("lang").alias("domain")))


@query(f"WITH {DOMAINS} SELECT file_path, domain FROM fd")
def domain_nearest(spark, d):
    return _file_domains(spark, d)


@query(f"WITH {DOMAINS} SELECT coalesce(domain, 'none') AS domain, count(*) AS n FROM fd GROUP BY 1")
def domain_partition_counts(spark, d):
    return domains.counts(domains.partitioned(_file_domains(spark, d)))


@query(f"WITH {DOMAINS} SELECT domain, row_number() OVER (ORDER BY domain = 'none', lower(domain), domain) - 1 AS place FROM (SELECT DISTINCT coalesce(domain, 'none') AS domain FROM fd)")
def domain_order(spark, d):
    return _in_order(domains.in_order(domains.partitioned(_file_domains(spark, d)).select("domain").distinct()))


@query(f"WITH {DOMAINS} SELECT ftype, max(coalesce(domain, 'none')) AS last FROM fd GROUP BY 1")
def domain_global_merge(spark, d):
    v = domains.partitioned(_file_domains(spark, d)).join(files(spark, d).select("file_path", "ftype"), "file_path").withColumn("last", F.col("domain"))
    return plan.merged(v, ["ftype"], ["last", "file_path"]).select("ftype", "last")


# --- tags


def _word(i: int):
    """The i-th word of ASCII letters of a text, from 0."""
    return F.coalesce(F.get(F.regexp_extract_all("content", F.lit("[A-Za-z]+"), F.lit(0)), F.lit(i)), F.lit("zz"))


def _tagged(spark, d):
    """A file whose tags are words of its text: a list, a plain line, hashtags, and what looks like tags and isn't."""
    made = F.concat(
        F.lit("---\ntitle: t\nTags: ["), _word(0), F.lit(", '"), _word(1), F.lit("', \""), _word(2), F.lit("\"]\ntag:  "), _word(3), F.lit(" , '"), _word(4), F.lit("',\nother: "), _word(5), F.lit("\n---\n#"), _word(6), F.lit(" and `#"), _word(7),
        F.lit("` x#"), _word(8), F.lit(" (#no) #12 #Include\n```\n#"), _word(9), F.lit("\n```\n#"), _word(10), F.lit("-"), _word(11), F.lit(", end\n"), F.col("content"),
    )
    return files(spark, d).select("file_path", "name", made.alias("content"))


TAGS = FILES + """,
    w AS (SELECT file_path, regexp_extract_all(content, '[A-Za-z]+') AS w FROM f),
    z AS (SELECT file_path, list_transform(range(1, 13), lambda i: coalesce(w[i], 'zz')) AS z FROM w),
    fm AS (SELECT DISTINCT file_path, unnest([z[1], z[2], z[3], z[4], chr(39) || z[5] || chr(39)]) AS tag FROM z),
    ht AS (SELECT DISTINCT file_path, tag FROM (SELECT file_path, unnest([z[7], z[11] || '-' || z[12]]) AS tag FROM z) WHERE lower(tag) NOT IN ('define', 'include', 'ifndef', 'endif', 'pragma', 'undef', 'if', 'else', 'error', 'warning', 'line'))"""


@query(f"WITH {TAGS} SELECT file_path, tag FROM ht")
def tag_hashtags(spark, d):
    return _tagged(spark, d).select("file_path", F.explode(T.hashtags(F.col("content"))).alias("tag"))


@query(f"WITH {TAGS} SELECT file_path, tag FROM fm")
def tag_frontmatter(spark, d):
    return _tagged(spark, d).select("file_path", F.explode(T.frontmatter_tags(F.col("content"))).alias("tag"))


@query(f"WITH {TAGS} SELECT tag, count(*) AS n_files FROM (SELECT * FROM fm UNION SELECT * FROM ht) GROUP BY 1")
def tag_index(spark, d):
    t = _tagged(spark, d).select("file_path", F.explode(F.array_union(T.hashtags(F.col("content")), T.frontmatter_tags(F.col("content")))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n_files"))


# --- rendered lines, in order


def _index(spark, d, made: DataFrame, areas: DataFrame | None = None):
    f = made.select("file_path", T.parent_dir(F.col("file_path")).alias("dir"), T.base_name(F.col("file_path")).alias("name"), T.file_type(F.col("file_path")).alias("ftype"), "content").filter("ftype <> 'card'")
    return plan.KnowledgeIndex(f, areas if areas is not None else spark.createDataFrame([], "dir string, domain string"), Config(["/kb"]), keywords.parse("Words\n\twith\n\tthe:nosuchword\nmit"))


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines of a view with their place in it."""
    return lines.select(F.row_number().over(Window.partitionBy("domain").orderBy("path", "text", "link")).cast("bigint").alias("n"), (F.size("path") - 1).cast("bigint").alias("depth"), "text", "link")


@query(f"""WITH {TAGS}, t AS (SELECT tag, file_path FROM fm WHERE NOT ends_with(file_path, '.kb.md') AND NOT ends_with(file_path, '.mm') UNION SELECT tag, file_path FROM ht WHERE NOT ends_with(file_path, '.kb.md') AND NOT ends_with(file_path, '.mm')),
    l AS (SELECT DISTINCT tag, 0::BIGINT AS depth, '' AS link, tag AS text FROM t UNION ALL SELECT tag, 1, file_path, regexp_extract(file_path, '[^/]*$') FROM t)
    SELECT row_number() OVER (ORDER BY lower(tag), tag, depth, link) AS n, depth, text, nullif(link, '') AS link FROM l""")
def markdown_tag_lines(spark, d):
    return _numbered(render.tag_rows(_index(spark, d, _tagged(spark, d)), "markdown", "/home"))


@query(f"""WITH {FILES}, p AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS x FROM f WHERE ftype <> 'card'),
    l AS (SELECT DISTINCT x[3] AS a, 0 AS o, '' AS b, 0 AS q, '' AS c, 0::BIGINT AS depth, x[3] || '/' AS text, NULL AS link FROM p UNION ALL SELECT DISTINCT x[3], 1, x[4], 0, '', 1, x[4] || '/', NULL FROM p UNION ALL SELECT x[3], 1, x[4], 1, x[5], 2, x[5], file_path FROM p)
    SELECT row_number() OVER (ORDER BY a, o, b, q, c) AS n, depth, text, link FROM l""")
def markdown_file_lines(spark, d):
    return _numbered(render.file_rows(_index(spark, d, files(spark, d)), "markdown", "/home"))


@query("""WITH i AS (SELECT s_nationkey AS k, s_name AS t, lower(s_name) AS lt, upper(left(s_name, 1)) AS letter, count(*) OVER (PARTITION BY s_nationkey) AS n, count(*) OVER (PARTITION BY s_nationkey, upper(left(s_name, 1))) AS m, row_number() OVER (PARTITION BY s_nationkey, upper(left(s_name, 1)) ORDER BY lower(s_name), s_name) - 1 AS r FROM supplier),
    c AS (SELECT *, CASE WHEN n > 3 AND m > 3 THEN r // ceil(m / ceil(m / 3.0))::BIGINT END AS chunk FROM i),
    e AS (SELECT *, upper(left(min_by(t, lt) OVER w, 3)) AS x, upper(left(max_by(t, lt) OVER w, 3)) AS y FROM c WINDOW w AS (PARTITION BY k, letter, chunk))
    SELECT k AS s_nationkey, t AS s_name, CASE WHEN n <= 3 THEN '' WHEN m <= 3 THEN letter ELSE letter || '/' || CASE WHEN x = y THEN x ELSE x || '–' || y END END AS buckets FROM e""")
def bucket_path(spark, d):
    b = buckets.letter_path(table(spark, d, "supplier").select("s_nationkey", "s_name"), ["s_nationkey"], "s_name", 3)
    return b.select("s_nationkey", "s_name", F.array_join(F.transform("buckets", lambda x: x["a"]), "/").alias("buckets"))


@query(f"""WITH {MARKED}, m AS (SELECT file_path, line_number, kind, level, text, row_number() OVER (PARTITION BY file_path ORDER BY line_number) AS pre FROM k WHERE kind <> 'content'),
    sec AS (SELECT file_path, section, string_agg(text, ' ' ORDER BY line_number) AS content, min(line_number) AS line_number FROM (SELECT *, sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_number) AS section FROM k) WHERE section > 0 AND kind <> 'list_item' GROUP BY 1, 2),
    h AS (SELECT m.file_path, m.pre, (SELECT max(g.pre) FROM m g WHERE g.file_path = m.file_path AND g.kind = 'heading' AND g.pre <= m.pre) AS hp FROM m LEFT JOIN sec ON sec.file_path = m.file_path AND sec.line_number = m.line_number
        WHERE regexp_matches(regexp_replace(lower(CASE WHEN m.kind = 'heading' THEN sec.content ELSE m.text END), '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]', '0', 'g'), '\\b(?:with)\\b')),
    a AS (SELECT h.file_path, h.pre, regexp_replace(regexp_replace(regexp_replace(lower(g.text), '[^a-z0-9_\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS anchor FROM h JOIN m g ON g.file_path = h.file_path AND g.pre = h.hp)
    SELECT file_path, anchor, min(pre) AS pre FROM a GROUP BY 1, 2""")
def hits_by_heading(spark, d):
    n = markdown.nodes(_marked(spark, d))
    return keywords.by_heading(search.search_sequence(n, ["with"]).select("file_path", "pre"), n, []).select("file_path", "anchor", "pre")


# --- words

PLAIN = "regexp_replace(lower(text), '[\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]', '0', 'g')"
TOKENS = f"t AS (SELECT doc_id, text, unnest(regexp_extract_all({PLAIN}, '\\b[a-z]+(?:[_-][a-z]+)*\\b')) AS word FROM documents)"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
CASED = "regexp_replace(text, '[\\x{00AA}\\x{00B5}\\x{00BA}\\x{00C0}-\\x{00D6}\\x{00D8}-\\x{00F6}\\x{00F8}-\\x{024F}]', '0', 'g')"
SIGNIFICANT = TOKENS + f""", capital AS (SELECT DISTINCT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all({CASED}, '\\b[A-Z][a-z]\\b')) AS w FROM documents)),
    w AS (SELECT t.doc_id, t.word FROM t LEFT JOIN capital c ON c.doc_id = t.doc_id AND c.word = t.word WHERE length(t.word) BETWEEN 2 AND 50 AND (t.word IN {_IN(T.TECHNICAL)} OR (t.word NOT IN {_IN(T.STOP_WORDS)}
        AND (length(t.word) >= 3 OR t.word IN ('ty', 'er', 'ar', 'al', 'ic') OR c.word IS NOT NULL))))"""


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_path"), F.lit(1).cast("bigint").alias("pre"), F.col("text").alias("search_text"))


def _occurrences(spark, d):
    return words.occurrences(_texts(spark, d))


@query(f"WITH {TOKENS} SELECT word, count(*) AS n FROM t GROUP BY 1")
def tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"WITH {SIGNIFICANT} SELECT DISTINCT doc_id, word FROM w")
def significant_words(spark, d):
    return words.hits(_texts(spark, d)).select(F.col("file_path").alias("doc_id"), "word")


@query(f"WITH {SIGNIFICANT} SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 5")
def word_occurrences(spark, d):
    return words.frequency(_occurrences(spark, d), 5)


@query(f"WITH {SIGNIFICANT} SELECT word, count(DISTINCT doc_id) AS n_files FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def word_docfreq(spark, d):
    return words.document_frequency(words.hits(_texts(spark, d)))


_BASE = "CASE " + " ".join(f"WHEN ends_with(word, '{s}') AND length(word) > {len(s) + 2} THEN left(word, length(word) - {len(s)})" for s in T.SUFFIXES) + " ELSE word END"


@query(f"WITH {SIGNIFICANT}, v AS (SELECT DISTINCT word FROM w), b AS (SELECT word, {_BASE} AS base FROM v) SELECT b.word, b.base FROM b JOIN v ON v.word = b.base WHERE b.word <> b.base")
def word_suffix_pairs(spark, d):
    return words.suffix_pairs(_occurrences(spark, d).select("word").distinct())


@query()
def word_consolidate(spark, d):
    return words.consolidate(words.first_files(_occurrences(spark, d)))


@query(f"""WITH {SIGNIFICANT}, v AS (SELECT DISTINCT word, left(word, 1) AS c, left(word, 2) AS p, left(word, 3) AS q FROM w),
    l AS (SELECT c, r, k, CASE WHEN k <= 24 THEN NULL WHEN r <= 2 * (k - 24) THEN min(c) OVER (PARTITION BY k, (r - 1) // 2) || '-' || max(c) OVER (PARTITION BY k, (r - 1) // 2) ELSE c END AS above
        FROM (SELECT c, row_number() OVER (ORDER BY c) AS r, count(*) OVER () AS k FROM (SELECT DISTINCT c FROM v))),
    m AS (SELECT *, CASE WHEN k <= 24 THEN sum(n) OVER () ELSE sum(n) OVER (PARTITION BY above) END AS level_words, CASE WHEN k <= 24 THEN k ELSE count(*) OVER (PARTITION BY above) END AS level_letters FROM l JOIN (SELECT c, count(*) AS n FROM v GROUP BY 1) USING (c)),
    x AS (SELECT c, p, row_number() OVER (PARTITION BY c ORDER BY p) AS r, count(*) OVER (PARTITION BY c) AS n_p FROM (SELECT DISTINCT c, p FROM v)),
    y AS (SELECT *, CASE WHEN n_p > 24 THEN CASE WHEN count(*) OVER g = 1 THEN p ELSE min(p) OVER g || '-' || max(p) OVER g END END AS prefix_range FROM x WINDOW g AS (PARTITION BY c, (r - 1) // ceil(n_p / 24.0)::BIGINT)),
    t3 AS (SELECT p, q, count(*) OVER (PARTITION BY p) AS n_q FROM (SELECT DISTINCT p, q FROM v)),
    j AS (SELECT v.*, m.above, m.level_words, m.level_letters, m.n AS n_c, y.prefix_range, t3.n_q, count(*) OVER (PARTITION BY v.p) AS n_w, row_number() OVER (PARTITION BY v.p ORDER BY v.word) - 1 AS i FROM v JOIN m ON m.c = v.c JOIN y ON y.p = v.p JOIN t3 ON t3.q = v.q AND t3.p = v.p),
    s AS (SELECT *, i // greatest(1, n_w // 24) AS slice FROM j),
    e AS (SELECT *, CASE WHEN count(*) OVER h = 1 THEN word WHEN left(min(word) OVER h, 3) = left(max(word) OVER h, 3) THEN left(min(word) OVER h, 3) ELSE left(min(word) OVER h, 3) || '-' || left(max(word) OVER h, 3) END AS label FROM s WINDOW h AS (PARTITION BY p, slice)),
    b AS (SELECT p, slice, row_number() OVER (PARTITION BY p, label ORDER BY slice) AS again FROM (SELECT DISTINCT p, slice, label FROM e))
    SELECT word, concat_ws('/', above, CASE WHEN level_words <= 24 OR n_c = 1 THEN NULL WHEN n_c <= 24 THEN CASE WHEN level_letters > 1 THEN c END WHEN prefix_range IS NOT NULL THEN prefix_range WHEN n_w <= 24 THEN e.p
        WHEN n_q <= 24 THEN e.p || '/' || q ELSE e.p || '/' || label || CASE WHEN again > 1 THEN ' (' || again || ')' ELSE '' END END) AS path FROM e JOIN b ON b.p = e.p AND b.slice = e.slice""")
def word_groups(spark, d):
    return words.word_groups(words.hits(_texts(spark, d))).select("word", F.array_join("path", "/").alias("path"))


# --- buckets


@query("SELECT s_nationkey, s_name, CASE WHEN count(*) OVER (PARTITION BY s_nationkey) > 5 THEN CASE WHEN regexp_matches(upper(left(s_name, 1)), '[A-Z]') THEN upper(left(s_name, 1)) ELSE '#' END END AS bucket FROM supplier")
def letter_buckets(spark, d):
    return buckets.letter_buckets(table(spark, d, "supplier").select("s_nationkey", "s_name"), "s_nationkey", "s_name", 5).select("s_nationkey", "s_name", "bucket")


@query("""WITH c AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_name) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT c_nationkey, c_name, (r // ceil(n / ceil(n / 20.0))::BIGINT)::BIGINT AS chunk FROM c""")
def range_chunks(spark, d):
    return buckets.range_chunks(table(spark, d, "customer").select("c_nationkey", "c_name"), "c_nationkey", "c_name").select("c_nationkey", "c_name", "chunk")


@query(f"""WITH {FILES}, r AS (SELECT dir, file_path, CASE ftype WHEN 'freeplane' THEN 0 WHEN 'markdown' THEN 1 ELSE 2 END AS k FROM f), c AS (SELECT dir, count(*) AS n, count(DISTINCT k) AS kinds FROM r GROUP BY 1)
    SELECT r.dir, file_path, CASE WHEN n > 20 AND kinds > 1 THEN k END AS bucket FROM r JOIN c ON r.dir = c.dir""")
def type_buckets(spark, d):
    return buckets.type_buckets(files(spark, d).select("dir", "file_path"), "dir", "file_path").select("dir", "file_path", "bucket")


# --- file system, cards


@query("SELECT dir, count(*) AS n FROM (SELECT unnest(list_transform(range(3, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS dir FROM (SELECT string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?:/', ''), '/') AS p FROM pages)) GROUP BY 1")
def fs_tree_dirs(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?:/", "")
    return table(spark, d, "pages").select(F.explode(F.filter(T.ancestors(path), lambda x: F.size(F.split(x, "/")) > 2)).alias("dir")).groupBy("dir").agg(F.count("*").alias("n"))


def _cards(spark, d):
    """A card for each part: a summary by 10, its source by 7 of the size, the part before it as what it builds on."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("domain"), F.concat(F.lit("/kb/"), "p_brand", F.lit("/.kb/"), s(k), F.lit(".kb.md")).alias("file_path"), k.alias("ord"), s(k).alias("id"), F.concat(F.lit("s"), s(k)).alias("slug"),
        F.when(k % 10 == 0, "file_summary").when(k % 11 == 0, "dir_summary").alias("kind"), F.col("p_name").alias("title"), F.concat(F.lit("/kb/"), "p_brand", F.lit("/"), s(F.col("p_size") % 7)).alias("source_path"), F.concat(F.lit("e"), s(k)).alias("essence"),
        F.array(F.concat(F.lit("s"), s(k - 1))).alias("builds_on"), F.array(F.concat(F.lit("t"), s(k % 100))).alias("defines"), F.array(F.concat(F.lit("/kb/x/"), s(k * 2))).alias("exported_as"), F.array().cast("array<string>").alias("refines"),
    )


CARDS = """c AS (SELECT p_brand AS domain, '/kb/' || p_brand || '/.kb/' || p_partkey || '.kb.md' AS file_path, p_partkey AS ord, CASE WHEN p_partkey % 10 = 0 THEN 'file_summary' WHEN p_partkey % 11 = 0 THEN 'dir_summary' END AS kind, p_name AS title,
    '/kb/' || p_brand || '/' || p_size % 7 AS source_path, 'e' || p_partkey AS essence FROM part)"""


@query(f"""WITH {CARDS}, g AS (SELECT domain, source_path, count(*) FILTER (kind IS NOT NULL) AS s, count(*) FILTER (kind IS NULL) AS t, arg_min(essence, ord) FILTER (kind IS NOT NULL) AS se, arg_min(file_path, ord) FILTER (kind IS NOT NULL) AS sp, arg_min(essence, ord) FILTER (kind IS NULL) AS te,
    count(*) AS n_cards FROM c WHERE kind IS DISTINCT FROM 'dir_summary' GROUP BY 1, 2)
    SELECT domain, source_path, CASE WHEN s > 0 THEN se WHEN t = 1 THEN te END AS annotation, CASE WHEN s > 0 AND t > 0 THEN sp END AS hidden_card, n_cards FROM g""")
def card_group_annotation(spark, d):
    return cards.groups(_cards(spark, d)).select("domain", "source_path", "annotation", "hidden_card", F.size("cards").cast("bigint").alias("n_cards"))


@query(f"WITH {CARDS} SELECT domain, source_path AS dir, arg_max(essence, ord) AS essence FROM c WHERE kind = 'dir_summary' GROUP BY 1, 2")
def dir_annotation(spark, d):
    return cards.dir_annotations(_cards(spark, d))


@query(f"WITH {CARDS} SELECT c.domain, c.file_path AS src_path, c.title AS src_title, coalesce(t.title, 's' || (c.ord - 1)) AS tgt_label, t.file_path AS tgt_path FROM c LEFT JOIN c t ON t.ord = c.ord - 1")
def deps_left_join(spark, d):
    return cards.dependencies(_cards(spark, d)).drop("pos")


@query(f"WITH {CARDS} SELECT domain, 't' || ord % 100 AS term, arg_max(title, ord) AS title, arg_max(file_path, ord) AS file_path FROM c GROUP BY 1, 2")
def glossary_last_wins(spark, d):
    return cards.glossary(_cards(spark, d))


@query("SELECT '/kb/x/' || p_partkey AS file_path FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey * 2 = part.p_partkey AND q.p_partkey % 11 <> 0 OR q.p_partkey * 2 = part.p_partkey AND q.p_partkey % 10 = 0)")
def fs_anti_absorbed(spark, d):
    f = table(spark, d, "part").select(F.concat(F.lit("/kb/x/"), F.col("p_partkey").cast("string")).alias("file_path"), F.lit("markdown").alias("ftype"))
    return cards.not_absorbed(f, cards.groups(_cards(spark, d))).select("file_path")


@query("""SELECT '/kb/a/.kb/' || p_partkey || '.kb.md' AS file_path, p_partkey::VARCHAR AS id, 's' || p_partkey AS slug, 'a,' || p_brand AS tags, 'first second' AS essence, '/kb/a/n.md' AS source_path,
    '{"id":' || p_partkey || ',"meta":{"k":1},"slug":"s' || p_partkey || '","source":["https://x","../n.md"],"tags":["a","' || p_brand || '"]}' AS fm FROM part""")
def card_frontmatter(spark, d):
    made = F.concat(F.lit("---\nid: "), F.col("p_partkey").cast("string"), F.lit("\nslug: s"), F.col("p_partkey").cast("string"), F.lit("\ntags: [a, "), "p_brand", F.lit("]\nsource: [https://x, ../n.md]\nmeta: {k: 1}\n---\n# "), "p_name", F.lit("\n> first\n> second\n\ntext"))
    f = table(spark, d, "part").select(F.concat(F.lit("/kb/a/.kb/"), F.col("p_partkey").cast("string"), F.lit(".kb.md")).alias("file_path"), made.alias("content"))
    return cards.with_source(cards.parse(f)).select("file_path", "id", "slug", F.array_join("tags", ",").alias("tags"), "essence", "source_path", F.col("fm").cast("string").alias("fm"))


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS file_path, p_brand, p_type FROM part)
    SELECT file_path, 1::BIGINT AS pre, 3::BIGINT AS last, NULL::BIGINT AS parent_pre, p_brand AS text, '' AS note, 'a,b' AS tags, p_brand || ' ' || p_brand AS search_text FROM p UNION ALL
    SELECT file_path, 2, 2, 1, 'x & ' || chr(160), 'n m', '', 'x & ' || chr(160) || ' x & ' || chr(160) || ' n m n m' FROM p UNION ALL SELECT file_path, 3, 3, 1, p_type, '', '', p_type || ' ' || p_type FROM p""")
def mm_parse(spark, d):
    made = F.concat(F.lit('<map version="1.0"><node ID="R" TEXT="'), "p_brand", F.lit('" TAGS="a&#xa;b"><node TEXT="x &amp;amp; &nbsp;"><richcontent TYPE="NOTE"><html><body><p>n </p><p>m</p></body></html></richcontent></node><node TEXT="'), "p_type", F.lit('"/></node></map>'))
    f = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file_path"), made.alias("content"))
    return mindmap.nodes(f).select("file_path", "pre", "last", "parent_pre", "text", "note", F.array_join("tags", ",").alias("tags"), "search_text")


@query("""SELECT p_partkey AS id, 1::BIGINT AS pre, 3::BIGINT AS last, NULL::BIGINT AS parent_pre, 1 AS level, p_brand AS text, '' AS note, '' AS tags FROM part WHERE p_partkey % 10 <> 0 UNION ALL
    SELECT p_partkey, 2, 3, 1, 2, p_type, '', 'a,' || p_size FROM part WHERE p_partkey % 10 <> 0 UNION ALL
    SELECT p_partkey, 3, 3, 2, 3, '', p_name, '' FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 10 = 0""")
def mm_table_function(spark, d):
    """Maps parsed by SQL: a table function joined laterally; every tenth file is no map and keeps a row of nulls."""
    made = F.concat(F.lit('<map><node TEXT="'), "p_brand", F.lit('"><node TEXT="'), "p_type", F.lit('" TAGS="a '), F.col("p_size").cast("string"), F.lit('"><node><richcontent TYPE="NOTE"><html><body><p>'), "p_name", F.lit("</p></body></html></richcontent></node></node></node>"), F.when(F.col("p_partkey") % 10 == 0, "").otherwise("</map>"))
    mindmap.register(spark)
    return spark.sql("SELECT f.id, n.pre, n.last, n.parent_pre, n.level, n.text, n.note, array_join(n.tags, ',') AS tags FROM {f} f LEFT JOIN LATERAL mindmap_nodes(f.content) n ON TRUE", f=table(spark, d, "part").select(F.col("p_partkey").alias("id"), made.alias("content")))


# --- numbers of stages


@query(f"""WITH {NODES}, g AS (SELECT doc_id, ftype, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN ' ' || chr(10) WHEN doc_id % 13 = 0 THEN '{T.MARKER}' || content ELSE content END AS c FROM f),
    r AS (SELECT *, coalesce(contains(c[1:{T.MARKER_WINDOW}], '{T.MARKER}'), FALSE) AS made FROM g), u AS (SELECT * FROM r WHERE c IS NOT NULL AND NOT made)
    SELECT 'read' AS stage, 'rows' AS number, count(*) AS n FROM r UNION ALL SELECT 'read', 'bytes', coalesce(sum(doc_id), 0)::BIGINT FROM r UNION ALL SELECT 'read', 'unreadable', count(*) FROM r WHERE c IS NULL
    UNION ALL SELECT 'read', 'blank', count(*) FROM r WHERE NOT regexp_matches(c, '\\S') UNION ALL SELECT 'read', 'generated', count(*) FROM r WHERE made
    UNION ALL SELECT 'invalid', 'rows', count(*) FROM u WHERE ftype = 'freeplane' OR NOT regexp_matches(c, '\\S') UNION ALL SELECT 'search', 'rows', count(*) FROM n WHERE {_m('with')} UNION ALL SELECT 'search', 'furthest', max(pre) FROM n WHERE {_m('with')}""")
def stage_counts(spark, d):
    """Numbers taken while stages ran: files read, unreadable, blank and generated, invalid ones, hits of a search."""
    i, counts = F.col("doc_id"), Counts()
    text = F.when(i % 7 == 0, None).when(i % 11 == 0, " \n").when(i % 13 == 0, F.concat(F.lit(T.MARKER), "content")).otherwise(F.col("content"))
    every = files(spark, d).select("file_path", "dir", "name", "ftype", i.alias("length"), F.lit(0).cast("bigint").alias("mtime_ns"), F.lit("/kb").alias("root"), text.alias("content"))
    index = plan.KnowledgeIndex(source.usable(every, counts), spark.createDataFrame([], "dir string, domain string, source_exclude array<string>"), counts=counts)
    index.kept("invalid")
    counts.cut("search", search.search_multiple(nodes(spark, d), [["with"]]).select("file_path", "pre").distinct(), furthest=F.max("pre"))
    return counts.rows(spark)


# --- staleness


@query("SELECT o_custkey::VARCHAR AS dir, 'sha256:' || sha256(string_agg(o_orderkey || ',' || o_custkey || ',' || o_orderkey * 3 || chr(10), '' ORDER BY o_orderkey::VARCHAR)) AS fingerprint FROM orders GROUP BY 1")
def dir_fingerprint(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("dir"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("length"), (F.col("o_orderkey") * 3).alias("mtime_ns"))
    return stale.fingerprint(f)


@query(f"WITH {FILES} SELECT file_path AS source, doc_id % 3 = 0 AS stale FROM f UNION ALL SELECT file_path || '.gone', TRUE FROM f WHERE doc_id % 10 = 0")
def stale_content(spark, d):
    f = files(spark, d)
    h = F.concat(F.lit("sha256:"), F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16))
    m = f.select("dir", F.lit(None).cast("string").alias("kind"), F.col("file_path").alias("source"), F.when(F.col("doc_id") % 3 == 0, "sha256:zz").otherwise(h).alias("source_hash"))
    gone = f.filter("doc_id % 10 = 0").select("dir", F.lit(None).cast("string").alias("kind"), F.concat("file_path", F.lit(".gone")).alias("source"), F.lit("sha256:0").alias("source_hash"))
    return stale.changed(m.unionByName(gone), f).select("source", "stale")


@query(f"WITH {FILES}, t AS (SELECT * FROM f WHERE doc_id % 3 = 0), k AS (SELECT DISTINCT dir, regexp_extract(file_path, '(\\.[^./]*)$', 1) AS e FROM t) SELECT f.file_path FROM f JOIN k ON k.dir = f.dir AND k.e = regexp_extract(f.file_path, '(\\.[^./]*)$', 1) WHERE f.doc_id % 3 <> 0")
def untracked_sources(spark, d):
    f = files(spark, d)
    return stale.untracked(f.select("dir", "name", "file_path"), f.filter("doc_id % 3 = 0").select("dir", F.col("file_path").alias("source"))).select("file_path")


# --- scalar functions


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '! ' || p_type), '[^\\w-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part")
def anchor_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.anchor_slug(F.concat("p_name", F.lit("! "), "p_type")).alias("slug"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '-'), ''), 'index') AS slug FROM pages")
def domain_slug(spark, d):
    return table(spark, d, "pages").select("page_id", T.domain_slug(F.col("url")).alias("slug"))


@query("SELECT p_partkey, p_brand || '::' || p_partkey || '.kb.md' AS shown FROM part")
def display_path(spark, d):
    return table(spark, d, "part").select("p_partkey", T.display_path(F.concat(F.lit("/kb/"), "p_brand", F.lit("/.kb/"), F.col("p_partkey").cast("string"), F.lit(".kb.md")), "/kb").alias("shown"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN '/kb/n' || page_id ELSE url END AS target FROM pages")
def md_link_strip(spark, d):
    url, own = F.col("url"), F.concat(F.lit("/kb/n"), F.col("page_id").cast("string"))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("[a](<"), url, F.lit(">)"))).when(F.col("page_id") % 3 == 1, url).otherwise(F.concat(F.lit("[b]("), own, F.lit(")")))
    return table(spark, d, "pages").select("page_id", T.link_target(made).alias("target"))


@query("SELECT doc_id, 'first ' || lang || ' last' AS essence FROM documents")
def essence(spark, d):
    made = F.concat(F.lit("# t\n\n> first\n>> "), "lang", F.lit("\n> last\ntext\n> other"))
    return table(spark, d, "documents").select("doc_id", T.essence(made).alias("essence"))


@query("SELECT doc_id, '---' || chr(10) || 'domain: ' || CASE lang WHEN 'en' THEN 'english' ELSE lang END || chr(10) || '---' || chr(10) || 'domain: en' AS content FROM documents")
def rename_domain(spark, d):
    made = F.concat(F.lit("---\ndomain: "), "lang", F.lit("\n---\ndomain: en"))
    return table(spark, d, "documents").select("doc_id", T.renamed_domain(made, "en", "english").alias("content"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS shown FROM documents")
def shorten(spark, d):
    return table(spark, d, "documents").select("doc_id", T.shortened(F.col("text")).alias("shown"))


@query("SELECT page_id, '/a/' || page_id || '/c' AS path FROM pages")
def normal_path(spark, d):
    return table(spark, d, "pages").select("page_id", T.normal_path(F.concat(F.lit("/a/./b/../"), F.col("page_id").cast("string"), F.lit("//x/../c"))).alias("path"))


# --- grep

LINES = "g AS (SELECT doc_id::VARCHAR AS path, i AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def _plain(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


@query(f"WITH {LINES} SELECT path, line_no, md5(line) AS line_md5 FROM g WHERE regexp_matches(line, '(?i)license|stupid')")
def grep_lines(spark, d):
    return search.grep(_plain(spark, d), "license|stupid", ignore_case=True).select("path", "line_no", F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"WITH {LINES} SELECT DISTINCT path FROM g WHERE contains(line, 'Licensed')")
def grep_files(spark, d):
    return search.grep_files(search.grep(_plain(spark, d), "Licensed"))


@query(f"WITH {LINES} SELECT path, count(*) AS n FROM g WHERE NOT regexp_matches(line, 'the') GROUP BY 1")
def grep_count(spark, d):
    return search.grep_counts(search.grep(_plain(spark, d), "the", invert=True))


@query(f"WITH {LINES}, h AS (SELECT * FROM g WHERE contains(line, 'Licensed')) SELECT DISTINCT g.path, g.line_no FROM g JOIN h ON h.path = g.path AND g.line_no BETWEEN h.line_no - 1 AND h.line_no + 1")
def grep_context(spark, d):
    f = _plain(spark, d)
    return search.grep_context(f, search.grep(f, "Licensed"), 1).select("path", "line_no")


# --- more of the library's functions, over the same tables


@query(f"WITH {NODES} SELECT file_path, pre FROM n WHERE regexp_matches(plain, '\\bthe of\\b')")
def literal_term(spark, d):
    n = nodes(spark, d)
    return n.filter(F.col("search_text").rlike(T.literal_boundary("the of"))).select("file_path", "pre")


@query(f"WITH {NODES} SELECT file_path, pre FROM n WHERE regexp_matches(plain, '\\bwith,(\\s|$)')")
def literal_sign_term(spark, d):
    """A literal that ends in a sign has white space behind it."""
    return nodes(spark, d).filter(F.col("search_text").rlike(T.literal_boundary("with,"))).select("file_path", "pre")


@query(f"WITH {NODES} SELECT file_path, pre FROM n WHERE regexp_matches(lower(text), 'th[ae]t?.*wit')")
def raw_term(spark, d):
    return nodes(spark, d).filter(F.col("search_text").rlike(T.raw_pattern("th[ae]t?.*wit"))).select("file_path", "pre")


@query(f"WITH {NODES} SELECT file_path, count(*) AS n FROM n WHERE {_m('mit')} GROUP BY 1")
def search_files_grouped(spark, d):
    return search.group_by_file(search.search_files(nodes(spark, d), "mit"))


@query(f"""WITH {NODES}, a AS (SELECT file_path, pre, last FROM n WHERE {_m('the')}), h AS (SELECT n.file_path FROM a JOIN n ON n.file_path = a.file_path AND n.pre BETWEEN a.pre AND a.last WHERE {_m('by')})
    SELECT 'the:by' AS path, count(*) AS n, count(DISTINCT file_path) AS n_files FROM h""")
def search_grouped_by_path(spark, d):
    g = search.group_by_path(search.search_files(nodes(spark, d), "the : by"))
    return g.select(F.array_join("search_path", ":").alias("path"), "n", "n_files")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/kb/n' || page_id WHEN 1 THEN 'notes/' || page_id || '.md' END AS source FROM pages")
def local_source(spark, d):
    own = F.col("page_id").cast("string")
    listed = F.when(F.col("page_id") % 3 == 0, F.array(F.col("url"), F.concat(F.lit("[n](</kb/n"), own, F.lit(">)")))).when(F.col("page_id") % 3 == 1, F.array(F.concat(F.lit("[a]("), "url", F.lit(")")), F.concat(F.lit("notes/"), own, F.lit(".md")), F.lit("later"))).otherwise(F.array("url"))
    return table(spark, d, "pages").select("page_id", T.local_source(listed).alias("source"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'k/' || p_brand || '.md' WHEN 1 THEN '/kbx/k/' || p_brand || '.md#n1' ELSE 'k/' || p_brand || '.md#n2' END AS link FROM part")
def relative_links(spark, d):
    path = F.concat(F.when(F.col("p_partkey") % 3 == 1, "/kbx/k/").otherwise("/kb/k/"), "p_brand", F.lit(".md"))
    node = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("p_partkey") % 3).cast("string")))
    return table(spark, d, "part").select("p_partkey", T.relative_link(path, "/kb", node).alias("link"))


@query("SELECT p_partkey, '[' || p_name || '](</kb/a b/' || p_partkey || '.md>)' AS link, replace(p_type || ':' || p_brand, ':', ' → ') AS shown FROM part")
def markdown_links(spark, d):
    target = F.concat(F.lit("/kb/a b/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return table(spark, d, "part").select("p_partkey", T.markdown_link(F.col("p_name"), target).alias("link"), T.keyword_display(F.concat("p_type", F.lit(":"), "p_brand")).alias("shown"))


@query("SELECT lang AS domain, CASE WHEN bool_and(source <> 'src1') THEN '/home/u' ELSE '' END AS base FROM documents GROUP BY 1")
def common_prefix(spark, d):
    path = F.when(F.col("source") == "src1", "/srv/x").otherwise(F.concat(F.lit("/home/u/"), "source"))
    return table(spark, d, "documents").select(F.col("lang").alias("domain"), path.alias("p")).groupBy("domain").agg(T.common_prefix(F.col("p"), "/home/u").alias("base"))


@query(f"WITH {KEYWORD_ROWS} SELECT kw_file, pre, level::INTEGER AS level, text, parent_pre, is_leaf, last, CASE WHEN is_leaf THEN replace(text, ':', '|') END AS sequence FROM ke")
def keyword_tree(spark, d):
    return keywords.parsed(_keyword_files(spark, d)).select("kw_file", "pre", F.col("level").cast("int"), "text", "parent_pre", "is_leaf", "last", F.array_join("sequence", "|").alias("sequence"))


@query(f"WITH {KEYWORD_ROWS} SELECT ke.kw_file, ke.pre, u.text AS above, ke.text, replace(ke.text, ':', ' → ') AS shown, CASE WHEN ke.is_leaf THEN replace(ke.text, ':', '|') END AS sequence FROM ke LEFT JOIN ke u ON u.kw_file = ke.kw_file AND u.pre = ke.parent_pre")
def keyword_hierarchy(spark, d):
    return keywords.entries(keywords.parsed(_keyword_files(spark, d))).select("kw_file", "pre", "above", "text", F.col("display_name").alias("shown"), F.array_join("search_sequence", "|").alias("sequence"))


@query(f"""WITH {FILES}, m AS (SELECT dir, max(doc_id % 3 = 0) AS bad, max(doc_id) % 2 = 0 AS same FROM f GROUP BY 1)
    SELECT count(*) FILTER (bad AND NOT same) AS stale, count(*) FILTER (NOT (bad AND NOT same)) AS current FROM m""")
def stale_totals(spark, d):
    f = files(spark, d)
    listed = f.select("dir", "name", "file_path", F.col("doc_id").alias("length"), F.col("doc_id").alias("mtime_ns"))
    same = listed.groupBy("dir").agg((F.max("length") % 2 == 0).alias("same"))
    heads = stale.fingerprint(listed).join(same, "dir").select("dir", F.when(F.col("same"), F.col("fingerprint")).otherwise("sha256:0").alias("fingerprint"))
    h = F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256))
    cards_ = f.select("dir", F.col("doc_id").cast("int").alias("pos"), F.lit(None).cast("string").alias("kind"), F.col("file_path").alias("source"), F.when(F.col("doc_id") % 3 == 0, "sha256:zz").otherwise(h).alias("source_hash"))
    return stale.totals(stale.scan(listed, f.select("file_path", "content"), heads, cards_))


@query("""SELECT '/kb/' || p_partkey AS dir, 'sha256:' || p_size AS fingerprint, i::INT AS pos, CASE i WHEN 0 THEN '/kb/' || p_partkey || '/n.md' WHEN 1 THEN '/abs/x.md' END AS source, CASE WHEN i < 2 THEN 'sha256:' || i END AS source_hash FROM part, (VALUES (0), (1), (2)) v(i)""")
def manifests(spark, d):
    own = F.col("p_partkey").cast("string")
    made = F.concat(F.lit("version: 1\ndir_fingerprint: sha256:"), F.col("p_size").cast("string"), F.lit("\ncards:\n- {slug: a, source: ../n.md, source_hash: 'sha256:0'}\n- {slug: b, source: [https://x.y, '[x](</abs/x.md>)'], source_hash: 'sha256:1'}\n- {slug: c, source: https://x.y}\n"))
    f = table(spark, d, "part").select(F.concat(F.lit("/kb/"), own, F.lit("/.kb/segmentation.yml")).alias("file_path"), F.lit("manifest").alias("ftype"), made.alias("content"))
    return source.parsed_manifests(f).select("dir", "fingerprint", F.inline("cards")).select("dir", "fingerprint", "pos", "source", "source_hash")


@query("SELECT '/kb/' || p_partkey AS dir, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS domain, CASE WHEN p_partkey % 2 = 0 THEN '*.tmp|a?' ELSE '' END AS excluded FROM part")
def area_settings(spark, d):
    even = F.col("p_partkey") % 2 == 0
    made = F.when(even, F.concat(F.lit("domain: '"), "p_brand", F.lit("'\nsource_exclude: ['*.tmp', 'a?']\n"))).otherwise("[not a mapping")
    f = table(spark, d, "part").select(F.concat(F.lit("/kb/"), F.col("p_partkey").cast("string"), F.lit("/.kb/kb.yml")).alias("file_path"), F.lit("area").alias("ftype"), made.alias("content"))
    return source.areas_of(f).select("dir", "domain", F.array_join("source_exclude", "|").alias("excluded"))


@query(f"WITH {CARDS} SELECT domain, source_path, string_agg(title, '|' ORDER BY ord) AS titles, string_agg(file_path, '|' ORDER BY ord) AS paths FROM c WHERE kind IS DISTINCT FROM 'dir_summary' GROUP BY 1, 2")
def card_members(spark, d):
    g = cards.groups(_cards(spark, d))
    return g.select("domain", "source_path", F.array_join(F.transform("cards", lambda c: c["label"]), "|").alias("titles"), F.array_join(F.transform("cards", lambda c: c["path"]), "|").alias("paths"))


@query(f"""WITH {SIGNIFICANT}, o AS (SELECT DISTINCT word, doc_id FROM w), k AS (SELECT word, count(*) AS n FROM o GROUP BY 1)
    SELECT word, n, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM o WHERE o.word = k.word ORDER BY doc_id LIMIT 25)) AS files FROM k WHERE n BETWEEN 20 AND 40""")
def word_first_files(spark, d):
    found = _occurrences(spark, d)
    n = words.document_frequency(found, 20).filter("n_files <= 40")
    return words.first_files(found).join(n, "word").select("word", F.col("n_files").alias("n"), F.array_join(F.transform("files", lambda x: x.cast("string")), ",").alias("files"))


@query(f"""WITH {DOMAINS}, e AS (SELECT file_path, 'en' AS need FROM fd WHERE domain = 'en'), k AS (SELECT * FROM (VALUES ('with', 0), ('mit', 1)) v(keyword, scoped)),
    h AS (SELECT d.domain, k.keyword, count(*) AS hits FROM fd d JOIN f ON f.file_path = d.file_path JOIN k ON regexp_matches(regexp_replace(lower(f.content), '[\\x{{00AA}}\\x{{00B5}}\\x{{00BA}}\\x{{00C0}}-\\x{{00D6}}\\x{{00D8}}-\\x{{00F6}}\\x{{00F8}}-\\x{{024F}}]', '0', 'g'), '\\b(?:' || k.keyword || ')\\b') AND (k.scoped = 0 OR d.domain = 'de') GROUP BY 1, 2)
    SELECT coalesce(domain, 'none') AS domain, keyword, sum(hits)::BIGINT AS hits FROM h GROUP BY 1, 2""")
def keyword_by_domain(spark, d):
    """Hits of global keywords in all domains and of one domain's in it alone; a file is a node here."""
    n = files(spark, d).select("file_path", F.lit(1).cast("bigint").alias("pre"), F.lit(1).cast("bigint").alias("last"), F.col("content").alias("text"), F.col("content").alias("search_text"))
    k = keywords.Keywords(keywords.parse("with", "g").rows + keywords.parse("mit", "s", ["de"]).rows)
    fd = domains.partitioned(_file_domains(spark, d))
    entries = keywords.scoped(keywords.chains(spark, k), fd.select("domain").distinct()).select("domain", F.col("text").alias("keyword"))
    hits = search.search_multiple(n, [["with"], ["mit"]]).select("file_path", F.col("sequence").alias("keyword")).join(fd, "file_path")
    return hits.join(entries, ["domain", "keyword"]).groupBy("domain", "keyword").agg(F.count("*").alias("hits"))
