"""Commands over a small tree of folders: search with its exit codes, staleness, renaming, listing by tasks, handlers, and the ordered lines of both renderers."""

import hashlib
import io
import os
import xml.etree.ElementTree as ET

import pytest

from treedex import cli, config
from treedex.operators import keywords, rename
from treedex.plans import index as plan, render
from treedex.sources import files as source


@pytest.fixture
def tree(tmp_path):
    a = tmp_path / "a"
    (a / ".kb").mkdir(parents=True)
    (a / "sub").mkdir()
    (a / "n.md").write_text("# Python notes\ntext #tag1\n- item python\n## Other\n- python runs\n- running python\n")
    (a / "sub" / "k.md").write_text("# Sub\npython text #Tag0\n")
    (a / "m.mm").write_text('<map><node TEXT="Root &amp; more" TAGS="t2"><node TEXT="python"/></node></map>')
    (a / "old.md").write_text("<!-- kbi:generated v=1 --> python")
    (a / ".kb" / "kb.yml").write_text("domain: area\n")
    (a / ".kb" / "c.kb.md").write_text("---\nid: 1\nslug: c\ntitle: Card\nsource: ../n.md\ndomain: dom\ndefines: [term]\nbuilds_on: [zz]\n---\n> gist\ndomain: dom\n")
    (tmp_path / "c.yml").write_text(f"directories:\n  include: ['{a}']\noutput:\n  format: markdown\n  file: '{tmp_path}/out'\n")
    return tmp_path


def search(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.run_search(spark, list(map(str, args)), out, err), out.getvalue().splitlines(), err.getvalue()


def test_search_command(spark, tree):
    c = tree / "c.yml"
    code, lines, _ = search(spark, c, "Python", "-w")
    assert code == 0 and lines == [f"{tree}/a/n.md:1:# Python notes"]
    assert search(spark, c, "nowhere")[0] == 1 and search(spark, c, "([")[0] == 2 and search(spark, tree / "none.yml", "x")[0] == 2
    code, lines, _ = search(spark, c, "python", "-i", "-l")
    assert code == 0 and [os.path.basename(x) for x in lines] == ["m.mm", "n.md", "k.md"]
    assert search(spark, c, "python", "-c")[1] == [f"{tree}/a/m.mm:1", f"{tree}/a/n.md:3", f"{tree}/a/sub/k.md:1"]
    assert search(spark, c, "##", "-F", "-C1")[1] == [f"{tree}/a/n.md-3-- item python", f"{tree}/a/n.md:4:## Other", f"{tree}/a/n.md-5-- python runs"]
    (tree / "e.yml").write_text(f"directories:\n  include: ['{tree}/none']\n")
    assert search(spark, tree / "e.yml", "x")[0] == 1


def test_listing(spark, tree):
    got = {(os.path.relpath(r.file_path, tree), r.ftype) for r in source.listed(spark, [str(tree), str(tree / "a")], ["**/sub/**"]).collect()}
    assert got == {("a/n.md", "markdown"), ("a/m.mm", "freeplane"), ("a/old.md", "markdown"), ("a/.kb/kb.yml", "area"), ("a/.kb/c.kb.md", "card")}
    deep = tree / "deep"
    for i in range(40):
        (deep / f"d{i}" / "x").mkdir(parents=True)
        (deep / f"d{i}" / "x" / "f.md").write_text("f")
    assert source.listed(spark, [str(deep)]).count() == 40
    assert sorted(r[0] for r in source.walk([str(tree / "a")])) == sorted(str(tree / "a" / x) for x in ("n.md", "sub/k.md", "m.mm", "old.md", ".kb/c.kb.md"))


def test_update_command(spark, tree):
    a, out = tree / "a", io.StringIO()

    def manifest(fingerprint, source_hash):
        (a / ".kb" / "segmentation.yml").write_text(f"version: 1\ndir_fingerprint: '{fingerprint}'\ncards:\n- {{slug: c, source: ../n.md, source_hash: '{source_hash}'}}\n- {{slug: m, source: '[m](<../m.mm>)', source_hash: 'sha256:{hashlib.sha256((a / 'm.mm').read_bytes()).hexdigest()[:16]}'}}\n- {{slug: o, source: ../old.md, source_hash: ''}}\n")

    entries = "".join(f"{n},{(a / n).stat().st_size},{(a / n).stat().st_mtime_ns}\n" for n in sorted(os.listdir(a)) if (a / n).is_file())
    whole = "sha256:" + hashlib.sha256((a / "n.md").read_bytes()).hexdigest()
    manifest("sha256:" + hashlib.sha256(entries.encode()).hexdigest(), "sha256:00")
    assert cli.run_update(spark, [str(tree)], out=out) == (0, 1)  # the fingerprint is the same: nothing is hashed
    manifest("sha256:0", whole)
    assert cli.run_update(spark, [str(tree)], out=out) == (1, 0)  # old.md is new: its entry has no hash
    (a / "old.md").unlink()
    assert cli.run_update(spark, [str(tree)], out=out) == (0, 1)
    (a / "CLAUDE.md").write_text("x")
    (a / "x.mm.md").write_text("x")
    assert cli.run_update(spark, [str(tree)], out=out) == (0, 1)
    (a / "draft.md").write_text("x")
    assert cli.run_update(spark, [str(tree)], out=out) == (1, 0)
    (a / ".kb" / "kb.yml").write_text("domain: area\nsource_exclude: ['dr*.md']\n")
    assert cli.run_update(spark, [str(tree)], out=out) == (0, 1)
    manifest("sha256:0", "sha256:00")
    assert cli.run_update(spark, [str(tree)], ["touch", "seen"], out=out) == (1, 0) and (a / "seen").exists()


def test_rename_command(spark, tree):
    card, area = tree / "a" / ".kb" / "c.kb.md", tree / "a" / ".kb" / "kb.yml"
    before = card.read_text()
    r = rename.rename_domain(spark, str(tree), "dom", "new$1", recursive=True, dry_run=True)
    assert r.changed == [str(card)] and r.skipped == 1 and card.read_text() == before
    out = io.StringIO()
    assert cli.run_rename(spark, [str(tree), "dom", "new$1", "-r"], out) == 0
    assert card.read_text() == before.replace("domain: dom\ndefines", "domain: new$1\ndefines") and area.read_text() == "domain: area\n"
    assert rename.rename_domain(spark, str(tree / "a" / ".kb"), "area", "zone").changed == [str(area)] and area.read_text() == "domain: zone\n"
    assert rename.rename_domain(spark, str(card), "new$1", "dom").changed == [str(card)]
    assert cli.run_rename(spark, [str(tree), "dom", "x"], out) == 1 and rename.in_reach(str(tree / "a" / "n.md")) == ([], [f"no card: {tree}/a/n.md"])


def test_handlers(spark, tree):
    from pyspark.sql import functions as F

    plain = plan.Handler("plain", lambda f: plan.markdown.nodes(f), plan.text_tags, plan.not_empty)
    try:
        plan.register(plain, [".note"])
        (tree / "a" / "x.note").write_text("# Note #tagx\n")
        (tree / "a" / "blank.md").write_text(" \n")
        ix = plan.KnowledgeIndex.from_config(spark, config.from_dict({"directories": {"include": [str(tree / "a")]}}))
        assert "tagx" in {r.tag for r in ix.tag().collect()} and {os.path.basename(r.file_path) for r in ix.invalid().collect()} == {"blank.md"}
        assert ix.nodes.filter(F.col("file_path").endswith("x.note")).count() == 1
    finally:
        plan.HANDLERS.pop("plain")
        plan.FILE_TYPES.pop(".note")


def test_keyword_hierarchy_and_scopes(spark, tree):
    h = keywords.hierarchy(keywords.parse("Top\n\ta:[b:c]\n\tx\nend"))
    assert list(h) == ["Top", "end"] and h["Top"]["children"]["x"]["level"] == 1 and h["end"]["search_sequence"] == ["end"] and h["Top"]["children"]["a:[b:c]"]["display_name"] == "a → [b → c]"
    (tree / "g.txt").write_text("python")
    (tree / "s.txt").write_text("text")
    k = keywords.load([str(tree / "g.txt")], [{"path": str(tree / "s.txt"), "domain": ["dom"]}])
    ix = plan.KnowledgeIndex.from_config(spark, config.from_dict({"directories": {"include": [str(tree / "a")]}}))
    ix.keyword_rows = k
    assert {(r.domain, r.text) for r in ix.keyword_entries().collect()} == {("area", "python"), ("dom", "python"), ("dom", "text")}


def test_renderers(spark, tree):
    ix = plan.KnowledgeIndex.from_config(spark, config.from_dict({"directories": {"include": [str(tree / "a")]}, "word_index": {"min_frequency": 1}, "output": {"format": "markdown", "file": str(tree / "out"), "views": {"word": True}}}))
    ix.keyword_rows = keywords.parse("Top\n\tpython\n\tnope\n")
    a = f"{tree}/a"
    out = render.to_markdown(ix, str(tree / "out"), home="/home/x")
    assert [os.path.basename(p) for p in out] == ["area.md", "dom.md", "INDEX.md"] and os.listdir(tree / "out").count(".lines") == 0
    body = open(out[0]).read().split("lost.\n", 1)[1]
    assert body.split("\n## Word Index")[0] == f"""
## File System

Base: `{a}`

- [m.mm](<{a}/m.mm>)
- [n.md](<{a}/n.md>)
- sub/
\t- [k.md](<{a}/sub/k.md>)

## Keyword Index

- Top
\t- python
\t\t- [m.mm](<{a}/m.mm>)
\t\t- [n.md](<{a}/n.md>)
\t\t- [k.md](<{a}/sub/k.md>)
\t- nope

## Tag Index

- t2
\t- [Root & more](<{a}/m.mm>)
- Tag0
\t- [k.md](<{a}/sub/k.md>)
- tag1
\t- [n.md](<{a}/n.md>)
"""
    assert f"- [n.md](<{a}/n.md>) — gist\n\t- [Card](<{a}/.kb/c.kb.md>)\n" in open(out[1]).read() and "\t- builds on: zz\n" in open(out[1]).read() and f"- term → [Card](<{a}/.kb/c.kb.md>)" in open(out[1]).read()
    assert "- [area](area.md) — 3 file(s)\n- [dom](dom.md) — 1 file(s)\n" in open(out[2]).read()
    render.to_mindmap(ix, str(tree / "out.mm"), home="/home/x", base=str(tree))
    top = ET.parse(tree / "out.mm").getroot().find("node")
    assert [n.get("TEXT") for n in top.findall("node")] == ["File System", "Keyword Index", "Tag Index", "Word Index", "Dependencies", "Glossary", "Domains"]
    area, dom = top.findall("node")[-1].findall("node")
    assert [n.get("TEXT") for n in area.findall("node")] == ["File System", "Keyword Index", "Tag Index", "Word Index"]
    python = area.findall("node")[1].find("node").findall("node")[1]
    assert [(n.get("LINK"), [x.get("TEXT") for x in n.findall("node")]) for n in python.findall("node")] == [("a/sub/k.md", ["Sub"]), ("a/m.mm", ["python"]), ("a/n.md", ["Python notes", "Other"])]
    note = next(n for n in dom.iter("node") if n.get("TEXT") == "n.md")
    assert note.find("richcontent").get("TYPE") == "DETAILS" and [x.get("TEXT") for x in note.findall("node")] == ["Card"]
    ids = [n.get("ID") for n in top.iter("node")]
    assert len(set(ids)) == len(ids)
    paths = render.to_tables(ix, str(tree / "tables"))
    assert {r.domain for r in spark.read.parquet(paths[0]).select("domain").distinct().collect()} == {"area"}
