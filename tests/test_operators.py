"""Behaviour on small inputs, and trees against a recursive oracle."""

import os
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from treedex import config
from treedex.functions import text as T
from treedex.operators import buckets, keywords, markdown, search, stale, tree, words
from treedex.plans import index as plan, render
from treedex.sources import files as source, mindmap


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_trees_against_a_stack(spark):
    rng, rows, want = random.Random(4), [], {}
    for f in range(12):
        stack, all_ = [], []
        for pre in range(1, 31):
            level = rng.randint(1, 5)
            while stack and stack[-1][1] >= level:
                stack.pop()
            all_.append((pre, level, stack[-1][0] if stack else None))
            stack.append((pre, level))
            rows.append((str(f), pre, level))
        for pre, level, parent in all_:
            last = next((p - 1 for p, k, _ in all_ if p > pre and k <= level), 30)
            want[str(f), pre] = (parent, last)
    n = tree.intervals(spark.createDataFrame(rows, "file_path string, pre bigint, level int"), levels=5)
    assert {(r.file_path, r.pre): (r.parent_pre, r["last"]) for r in n.collect()} == want


def _search(nodes, terms):
    """Depth first, as a bag."""
    import re

    hit = lambda n, t: re.search(rf"\b(?:{t})\b", n[3], re.I)
    now = [n for n in nodes if hit(n, terms[0])]
    for k, t in enumerate(terms[1:], 1):
        out = []
        for m in now:
            below = [n for n in nodes if n[0] == m[0] and m[1] <= n[1] <= m[2] and hit(n, t)]
            out += below if k == len(terms) - 1 else below[:1]
        now = out
    return sorted((n[0], n[1]) for n in now)


@pytest.mark.parametrize("terms", [["alpha"], ["alpha", "beta"], ["alpha", "beta", "gamma"], ["alpha", "alpha"], ["delta", "alpha", "beta", "gam.*"]])
def test_search_is_a_bag(spark, terms):
    rng = random.Random(7)
    rows = [(str(f), p, rng.randint(1, 4), rng.choice(["alpha", "Beta x", "gamma", "delta alpha", ""])) for f in range(10) for p in range(1, 26)]
    n = tree.intervals(spark.createDataFrame(rows, "file_path string, pre bigint, level int, text string"), levels=4).withColumn("search_text", F.col("text"))
    plain = [(r.file_path, r.pre, r["last"], r.text) for r in n.orderBy("file_path", "pre").collect()]
    assert sorted((r.file_path, r.pre) for r in search.search_sequence(n, terms).collect()) == _search(plain, terms)


def test_boundaries(spark):
    fits = lambda p, t: one(spark, F.col("t").rlike(p), t=t)
    assert fits(T.literal_boundary("C++"), "use C++ now") and not fits(T.literal_boundary("C++"), "C++++")
    assert fits(T.boundary("test"), "a TEST.") and not fits(T.boundary("test"), "contest testing")
    assert fits(T.boundary("écran"), "Écran")
    assert search.split_terms("function:[a:b]:x") == ["function", "[a:b]", "x"]
    assert search.valid_patterns(spark, ["a", "("]) == {"a": True, "(": False}


def test_markdown_sections_and_lists(spark):
    text = "intro\n# A\none\n- x\ntwo\n## B\n- y\n  - z\n# C\n"
    f = spark.createDataFrame([("f", text)], "file_path string, content string")
    n = {r.text: r for r in markdown.nodes(f).collect()}
    assert n["A"].content == "A one two" and n["C"].content == "C"
    assert n["y"].parent_pre == n["B"].pre and n["z"].parent_pre == n["y"].pre and n["x"].parent_pre == n["A"].pre
    assert {r.text: r.parent_pre for r in markdown.nodes(f, "compat").collect()}["x"] == 3


def test_markdown_white_space(spark):
    """Unicode's white space and the separators count as such; a list item's text keeps its end; a lone carriage return ends a line."""
    rows = ["\t# Tabbed", "#\xa0Wide \u2003", "\x1c## Sep\x1d", "\xa0", "#no", "- a  ", "\t\t\xa0\xa0* b", "\u0663. c", "x\x85", "####### seven", "# \x0b", "1.d"]
    f = spark.createDataFrame([("f", "\n".join(rows) + "\r\nlast\rvery last")], "file_path string, content string")
    got = [(r.line_number, r.kind, r.level, r.text) for r in markdown.lines(f).orderBy("line_number").collect()]
    assert got == [
        (1, "heading", 1, "Tabbed"), (2, "heading", 1, "Wide"), (3, "heading", 2, "Sep"), (5, "content", 0, "#no"), (6, "list_item", 0, "a  "), (7, "list_item", 2, "b"), (8, "list_item", 0, "c"),
        (9, "content", 0, "x"), (10, "content", 0, "####### seven"), (11, "content", 0, "#"), (12, "content", 0, "1.d"), (13, "content", 0, "last"), (14, "content", 0, "very last"),
    ]


def test_mindmap():
    got = mindmap.parse("p", '<map><node ID="a" TEXT="A &nbsp;b"><node TEXT="c"/><node TEXT="d" TAGS="x&#xa;y"/></node></map>')
    assert [(r[1], r[2], r[3]) for r in got] == [(1, 3, None), (2, 2, 1), (3, 3, 1)] and got[2][9] == ["x", "y"]
    assert mindmap.parse("p", "<x/>") == [] and mindmap.parse("p", "no") == [] and mindmap.parse("p", None) == []


def test_text_functions(spark):
    assert one(spark, T.hashtags(F.col("t")), t="#one `#no` x #12 #include #two-b\n```\n#code\n```") == ["one", "two-b"]
    assert one(spark, T.frontmatter_tags(F.col("t")), t="---\ntags:\n  - 'a'\n  - b\n---\n") == ["a", "b"]
    assert one(spark, T.essence(F.col("t")), t="# T\n> one\n> two\nx\n> no") == "one two"
    assert one(spark, T.link_target(F.col("t")), t="[a](<b c.md>)") == "b c.md"
    assert one(spark, T.renamed_domain(F.col("t"), "a", "b"), t="---\ndomain: a\n---\ndomain: a") == "---\ndomain: b\n---\ndomain: a"
    assert one(spark, T.normal_path(F.col("t")), t="/a/../b/./c") == "/b/c"
    assert one(spark, T.significant(F.col("w"), T.capitals(F.col("t"))), w="xy", t="an Xy") and not one(spark, T.significant(F.col("w"), T.capitals(F.col("t"))), w="xy", t="XY")


def test_keywords(spark):
    k = keywords.parse("# c\nA\n\tb:c\n    d\ne:f\n\tg\n")
    assert [(r[5], r[4], r[6]) for r in k.rows] == [("A", 0, False), ("b:c", 1, True), ("d", 1, True), ("e:f", 0, False), ("g", 1, True)]
    assert len(k.warnings) == 1
    n = spark.createDataFrame([("f", 1, 1, "x", "d")], "file_path string, pre bigint, last bigint, text string, search_text string")
    assert {r.keyword: r.pre for r in keywords.search(n, keywords.frame(spark, k)).collect()} == {"b:c": None, "d": 1, "g": None}


def consolidated(files):
    """Of words with their files, in the order first seen: the rules word by word over the whole vocabulary."""
    endings = ["ing", "ed", "er", "est", "ly", "tion", "sion", "ment", "ful", "less", "able", "ible"]

    def base(w):
        for e in [*endings, "s"]:
            if w.endswith(e) and len(w) > len(e) + 2:
                return w[: len(w) - len(e)]
        return w

    variant = lambda a, b: any(a == b + e or b == a + e for e in endings)
    out, used, bases = {}, set(), set()
    for word in files:
        if word in used or base(word) in bases:
            continue
        bases.add(base(word))
        same = [w for w in files if w not in used and (base(w) == base(word) or w == base(word))]
        same += [w for w in files if w not in used and w not in same and base(w) == word]
        group = [word]
        for w in same:
            if w != word and any(variant(g, w) for g in group) and len(set().union(*(files[g] for g in [*group, w]))) <= 24:
                group.append(w)
        used |= set(group)
        if len(group) == 1:
            out[word] = group
            continue
        short = min(group, key=len)
        if len({w.endswith("s") for w in group}) == 2:
            label = short.rstrip("s") + "s?"
        elif any(w.endswith(e) for w in group for e in ("ing", "ed", "er", "tion", "sion", "ment")):
            cut = [w[: -len(e)] for w in group if not w.startswith(short) for e in ("ing", "ed", "er", "tion", "sion", "ment") if w.endswith(e) and len(w) - len(e) >= 3]
            label = (cut[0] if cut else short) + ".*"
        else:
            label = short + ".*"
        out[label] = group
    for word in files:
        if word not in used:
            out[word] = [word]
    return sorted((label, w) for label, ws in out.items() for w in ws)


def test_consolidation(spark):
    rng = random.Random(3)
    stems = ["test", "run", "proces", "process", "nation", "use", "hope", "care", "play", "read", "mis", "teach", "work", "act"]
    tails = ["", "s", "ing", "ed", "er", "ers", "tion", "ment", "ful", "less", "able", "ly", "ss", "fully"]
    vocabulary = list(dict.fromkeys(rng.choice(stems) + rng.choice(tails) for _ in range(400)))
    files = {w: {f"f{rng.randint(0, 60):02d}" for _ in range(rng.choice([1, 2, 5, 12, 40]))} for w in vocabulary}
    rows = [(w, sorted(files[w])[:25], i) for i, w in enumerate(vocabulary)]
    got = words.consolidate(spark.createDataFrame(rows, "word string, files array<string>, ord int"))
    assert sorted((r.label, r.word) for r in got.collect()) == consolidated(files)


def test_consolidation_of_documents(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    n = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("file_path"), F.lit(1).cast("bigint").alias("pre"), F.col("text").alias("search_text")).filter("file_path < 12")
    found = words.occurrences(n).orderBy("file_path", "pos").collect()
    files = {}
    for r in found:
        files.setdefault(r.word, set()).add(r.file_path)
    got = words.consolidate(words.first_files(words.occurrences(n)))
    assert sorted((r.label, r.word) for r in got.collect()) == consolidated(files)


def test_chunks(spark):
    rows = [("p", f"w{i:03d}") for i in range(45)]
    got = buckets.range_chunks(spark.createDataFrame(rows, "p string, k string"), "p", "k").groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in got) == [15, 15, 15]


def test_files_index_and_renderers(spark, tmp_path):
    a = tmp_path / "a"
    (a / ".kb").mkdir(parents=True)
    (a / "n.md").write_text("# Python notes\ntext #tag1\n- item\n")
    (a / "old.md").write_text("<!-- kbi:generated v=1 -->\n# x")
    (a / "bad.md").write_bytes(b"\xff\xfe")
    (a / "m.mm").write_text('<map><node TEXT="Root" TAGS="t2"><node TEXT="python"/></node></map>')
    (a / ".kb" / "kb.yml").write_text("domain: area\n")
    (a / ".kb" / "c.kb.md").write_text("---\nid: 1\nslug: c\ntitle: Card\nsource: ../n.md\ndomain: dom\ndefines: [term]\nbuilds_on: [zz]\n---\n> gist\n")
    cfg = config.from_dict({"directories": {"include": [str(tmp_path)]}, "output": {"views": {"word": True}}, "word_index": {"min_frequency": 1}})
    ix = plan.KnowledgeIndex.from_config(spark, cfg)
    ix.keyword_rows = keywords.parse("python")
    assert {os.path.basename(r.file_path) for r in ix.files.collect()} == {"n.md", "m.mm", "c.kb.md"}
    assert {os.path.basename(r.file_path): r.domain for r in ix.file_domains.collect()} == {"n.md": "area", "m.mm": "area", "c.kb.md": "dom"}
    assert {(r.tag, r.domain) for r in ix.tag().collect()} == {("tag1", "area"), ("t2", "area")}
    assert ix.glossary().first().title == "Card" and ix.dependencies().first().tgt_label == "zz"
    assert "python" in {r.word for r in ix.word().collect()}
    out = render.to_markdown(ix, str(tmp_path / "out"))
    assert {os.path.basename(p) for p in out} == {"INDEX.md", "area.md", "dom.md"} and "kbi:generated" in open(out[0]).read()
    render.to_mindmap(ix, str(tmp_path / "out.mm"))
    assert ET.parse(tmp_path / "out.mm").getroot().tag == "map"


def test_config():
    with pytest.raises(config.ConfigError):
        config.from_dict({})
    with pytest.raises(config.ConfigError):
        config.from_dict({"directories": {"include": ["a"]}, "types": {"include": ["card"], "exclude": ["card"]}})
    c = config.from_dict({"directories": {"include": ["a"]}})
    assert c.view_enabled("tag") and not c.view_enabled("word")


def test_stale_dirs(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "dir string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "dir string, fingerprint string")
    ch = spark.createDataFrame([("a", True), ("b", True)], "dir string, stale boolean")
    empty = spark.createDataFrame([], "dir string")
    got = stale.stale_dirs(stored, now, ch, empty, stored)
    assert {r.dir: r.stale for r in got.collect()} == {"a": False, "b": True}
    assert tuple(stale.totals(got).first()) == (1, 1)


def test_walk_prunes(tmp_path):
    (tmp_path / "x" / "skip").mkdir(parents=True)
    (tmp_path / "x" / "skip" / "a.md").write_text("a")
    (tmp_path / "x" / "b.md").write_text("b")
    assert [r[2] for r in source.walk([str(tmp_path)], ["**/skip/**"])] == ["b.md"]
    assert source.roots([str(tmp_path / "x" / "b.md"), "/nope"])[0] == [str(tmp_path / "x")]


def test_stream(spark, tmp_path):
    from treedex.streaming.reindex import reindex

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A")
    seen = []
    q = reindex(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: seen.extend(r.text for r in markdown.nodes(df).collect()))
    q.awaitTermination(60)
    assert seen == ["A"]
