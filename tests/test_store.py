"""Views kept by file against a full build after any series of changes; the data source for trees, for batches and streams."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringContains, StringStartsWith

from treedex import cli, config
from treedex.operators import keywords
from treedex.plans.index import KnowledgeIndex
from treedex.plans.store import ViewStore
from treedex.sources import doctree
from treedex.streaming import reindex

WORDS = keywords.parse("Topics\n\talpha\n\tbeta:gamma\nnowhere")


def card(name, domain, extra=""):
    return f"---\nid: {name}\nslug: {name}\ntitle: {name}\nsource: ../{name}.md\ndomain: {domain}\ndefines: [t-{name}]\nbuilds_on: [other]\ntags: [x, {name}]\n---\n> about {name} {extra}\n"


def full(spark, root):
    return KnowledgeIndex.from_config(spark, config.from_dict({"directories": {"include": [str(root)]}, "word_index": {"min_frequency": 1}}))


def views(index):
    index.keyword_rows = WORDS
    out = {}
    for name in ("file_system", "dir_annotations", "keyword", "tag", "word", "dependencies", "glossary"):
        out[name] = sorted(map(repr, getattr(index, name)().collect()))
    out["domains"] = sorted(map(repr, index.file_domains.collect()))
    return out


def test_tables_equal_a_full_build(spark, tmp_path):
    root, rng = tmp_path / "kb", random.Random(1)
    (root / ".kb").mkdir(parents=True)
    (root / "sub" / ".kb").mkdir(parents=True)
    store = ViewStore(spark, f"file://{tmp_path}/store")
    cfg = config.from_dict({"directories": {"include": [str(root)]}, "word_index": {"min_frequency": 1}})

    def write(name, text):
        (root / name).write_text(text)

    def step(i):
        if i == 0:
            for n in "abcd":
                write(f"{n}.md", f"# {n} alpha\nbeta #tag{n}\n## gamma {n}\n- item\n")
            write(".kb/a.kb.md", card("a", "one"))
            write("sub/m.mm", '<map><node TEXT="beta" TAGS="mm"><node TEXT="gamma"/></node></map>')
        elif i == 1:  # changed, added, deleted; an area's settings appear
            write("a.md", "# changed\nalpha beta #tagnew\n")
            write("e.md", "# e\ngamma\n")
            (root / "b.md").unlink()
            write("sub/.kb/kb.yml", "domain: two\n")
        elif i == 2:  # a card changes its domain, a file becomes a generated one, one isn't UTF-8 any more
            write(".kb/a.kb.md", card("a", "three", "more"))
            write("c.md", "kbi:generated alpha")
            (root / "d.md").write_bytes(b"\xff\xfe alpha")
        else:  # all comes back otherwise
            write("b.md", f"# back {rng.random()}\nalpha\n")
            write("d.md", "# d again\nbeta\n")
            (root / "sub" / ".kb" / "kb.yml").unlink()

    counts = []
    for i in range(4):
        step(i)
        counts.append(store.sync([str(root)]))
        if i == 2:
            store.compact()
        if i in (1, 3):
            got, want = views(store.index(cfg)), views(full(spark, root))
            assert got == want, [k for k in want if got[k] != want[k]]
    assert counts[0] == (6, 0) and counts[1] == (3, 1) and counts[2] == (1, 2) and counts[3] == (2, 1) and store.sync([str(root)]) == (0, 0)
    before = sorted(map(repr, store.table("nodes").collect()))
    store.drop_old()
    assert sorted(map(repr, store.table("nodes").collect())) == before


def rows(spark, *files):
    return spark.createDataFrame([(p, os.path.dirname(p), os.path.basename(p), "markdown", len(t), 1, "/", t) for p, t in files], doctree.source.SCHEMA + ", content string")


def test_unfinished_and_repeated_batches(spark, tmp_path):
    store = ViewStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.table("nodes")
    store.update(rows(spark, ("/x/a.md", "# a"), ("/x/b.md", "# b")), batch=0)
    store.update(rows(spark, ("/x/a.md", "# a2")), batch=1)
    texts = lambda: sorted(r.text for r in store.table("nodes").collect())
    assert texts() == ["a2", "b"]
    store._remove(f"{store.path}/changes/batch=1")  # as if the batch had ended before its last step
    assert texts() == ["a", "b"]
    store.update(rows(spark, ("/x/a.md", "# a3\n## c")), spark.createDataFrame([("/x/b.md",)], "file_path string"), batch=1)
    store.update(rows(spark, ("/x/a.md", "# a3\n## c")), spark.createDataFrame([("/x/b.md",)], "file_path string"), batch=1)
    assert texts() == ["a3", "c"] and store.batches() == [0, 1]


def tree(root, opened=None):
    for d in ("a", "a/.kb", "a/b", "node_modules/x", "z"):
        (root / d).mkdir(parents=True, exist_ok=True)
    for n in ("a/1.md", "a/.kb/c.kb.md", "a/.kb/kb.yml", "a/b/2.mm", "a/b/no.txt", "node_modules/x/3.md", "z/4.markdown"):
        (root / n).write_text(f"text of {n}")


def test_source_for_batches(spark, tmp_path):
    tree(tmp_path)
    doctree.register(spark)
    f = spark.read.format("doctree").option("include", str(tmp_path)).option("exclude", "**/node_modules/**").load()
    got = {os.path.relpath(r.file_path, tmp_path): (r.ftype, r.content) for r in f.collect()}
    assert got == {n: (k, f"text of {n}") for n, k in (("a/1.md", "markdown"), ("a/.kb/c.kb.md", "card"), ("a/.kb/kb.yml", "area"), ("a/b/2.mm", "freeplane"), ("z/4.markdown", "markdown"))}
    names = lambda c: sorted(r.name for r in f.filter(c).collect())
    assert names("ftype = 'markdown'") == ["1.md", "4.markdown"] and names("ftype IN ('card', 'area') AND length > 0") == ["c.kb.md", "kb.yml"]
    assert names(F.col("file_path").startswith(f"{tmp_path}/a/b")) == ["2.mm"] and names(F.col("dir") == f"{tmp_path}/a") == ["1.md"] and names(F.col("dir").startswith(f"{tmp_path}/a/b/")) == []
    f.createOrReplaceTempView("trees")
    assert spark.sql("SELECT count(*) AS n FROM trees WHERE content LIKE '%2.mm%'").first().n == 1
    assert spark.read.format("doctree").option("include", f"{tmp_path}/none").load().count() == 0


def test_folders_that_are_not_opened(tmp_path, monkeypatch):
    tree(tmp_path)
    opened, scan = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or scan(p))

    def read(*filters):
        opened.clear()
        r = doctree.TreeReader({"include": str(tmp_path), "exclude": "**/node_modules/**"}, dict(doctree.source.FILE_TYPES))
        left = list(r.pushFilters(list(filters)))
        found = sorted(x for p in r.partitions() for b in r.read(p) for x in b.column("name").to_pylist())
        return found, set(opened), len(left)

    assert read()[1] == {".", "a", "a/.kb", "a/b", "z"}
    assert read(StringStartsWith(("file_path",), f"{tmp_path}/a/b/")) == (["2.mm"], {".", "a", "a/b"}, 0)
    assert read(EqualTo(("dir",), f"{tmp_path}/z")) == (["4.markdown"], {".", "z"}, 0)
    assert read(In(("ftype",), ("card",)), StringContains(("name",), "x"))[::2] == (["c.kb.md"], 1)


def test_stream_over_hidden_folders(spark, tmp_path):
    """New cards arrive once, also after a restart; the tables follow."""
    root = tmp_path / "kb"
    root.mkdir()
    tree(root)
    path, mark = f"file://{tmp_path}/views", f"file://{tmp_path}/mark"

    def run():
        q = reindex.keep_views(spark, [str(root)], path, mark, ["**/node_modules/**"], settle=0)
        q.awaitTermination()
        return ViewStore(spark, path)

    (root / "a" / ".kb" / "c.kb.md").write_text(card("c", "one"))
    store = run()
    assert sorted(r.title for r in store.table("cards").collect()) == ["c"] and len(store.batches()) == 1
    run()
    assert len(store.batches()) == 1
    (root / "a" / ".kb" / "d.kb.md").write_text(card("d", "two"))
    (root / "a" / "1.md").write_text("# new\n")
    old = tmp_path / "moved.md"
    old.write_text("# moved\n")
    os.utime(old, (1, 1))
    old.rename(root / "z" / "moved.md")
    run()
    assert sorted(r.title for r in store.table("cards").collect()) == ["c", "d"] and len(store.batches()) == 2
    last = store._read("changes").filter(f"batch = {store.batches()[-1]}").collect()
    assert sorted(os.path.basename(r.file_path) for r in last) == ["1.md", "d.kb.md", "moved.md"]
    assert {r.domain for r in store.index().file_domains.collect()} >= {"one", "two"}


def test_update_command(spark, tmp_path, capsys):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("# A\n")
    (tmp_path / "c.yml").write_text(f"directories:\n  include: ['{tmp_path}/kb']\n")
    import io

    for want in ("1 file(s) new or changed, 0 gone\n", "0 file(s) new or changed, 0 gone\n"):
        out = io.StringIO()
        assert cli.COMMANDS["update"](spark, [str(tmp_path / "c.yml"), f"file://{tmp_path}/store", "--compact"], out) == 0 and out.getvalue() == want
    assert cli.run_refresh(spark, [str(tmp_path / "none.yml"), "x"], out, io.StringIO()) == 2
