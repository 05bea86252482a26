"""Every key of a configuration, and what isn't one."""

import json

import pytest

from treedex import config
from treedex.operators import domains

WHOLE = """
directories:
  include: ["/notes"]
  exclude: ["**/photos/**"]
keywords:
  files:
    - "/notes/.kw.mmtxt"
    - {path: "/notes/a.txt", domain: work}
    - {path: "/notes/b.txt", domain: [home, work]}
output:
  file: "index.mm"
  format: freeplane
  partition_by_domain: off
  views:
    word: on
    tag: no
    glossary: auto
types:
  exclude: [card]
"""


def made(**sections):
    return config.from_dict({"directories": {"include": ["a"]}, **sections})


def test_every_key(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text(WHOLE)
    c = config.load(str(path))
    assert (c.include, c.exclude, c.exclude_types, c.include_types) == (["/notes"], ["**/photos/**"], ["card"], [])
    assert c.keyword_files == ["/notes/.kw.mmtxt", {"path": "/notes/a.txt", "domain": "work"}, {"path": "/notes/b.txt", "domain": ["home", "work"]}]
    assert (c.output, c.format, c.partition) == ("index.mm", "freeplane", "off")
    assert c.view_enabled("word") and not c.view_enabled("tag") and c.view_enabled("glossary") and c.view_enabled("keyword")


def test_defaults(tmp_path):
    c = made()
    assert c.exclude == config.EXCLUDE and c.partition == "auto" and c.keyword_files == [] and not c.view_enabled("word")
    assert made(output=None, keywords={"files": []}, types={"include": ["card"]}).include_types == ["card"]
    for form, name in (("freeplane", "mine.mm"), ("markdown", "mine")):
        (tmp_path / "mine.json").write_text(json.dumps({"directories": {"include": ["a"], "exclude": []}, "output": {"format": form}}))
        loaded = config.load(str(tmp_path / "mine.json"))
        assert (loaded.output, loaded.exclude) == (name, [])


@pytest.mark.parametrize(
    "bad",
    [
        {"directories": {}}, {"directories": {"include": []}}, {"directories": {"include": [1]}}, {"directories": {"include": ["a"], "depth": 1}}, {"keyword_files": ["x"]}, {"views": {"tag": "on"}}, {"output": {"path": "x"}},
        {"output": {"views": {"words": "on"}}}, {"output": {"views": {"tag": "perhaps"}}}, {"output": {"partition_by_domain": "never"}}, {"output": {"format": "html"}}, {"output": {"file": 3}}, {"output": "x"},
        {"types": {"include": ["card"], "exclude": ["markdown"]}}, {"types": {"include": ["text"]}}, {"types": {"only": []}}, {"keywords": {"files": "x"}}, {"keywords": {"files": [{"domain": "a"}]}},
        {"keywords": {"files": [{"path": "x", "domain": []}]}}, {"keywords": {"files": [{"path": "x", "area": "y"}]}}, {"extra": 1},
    ],
)
def test_errors(bad):
    with pytest.raises(config.ConfigError):
        config.from_dict({"directories": {"include": ["a"]}, **bad})


def test_partition_modes(spark):
    some = spark.createDataFrame([("f", "d"), ("g", None)], "file_path string, domain string")
    none = some.withColumn("domain", some.domain.substr(0, 0)).filter("file_path = 'g'")
    buckets = lambda f, m: {r.file_path: r.domain for r in domains.partitioned(f, m).collect()}
    assert buckets(some, "auto") == buckets(some, "on") == {"f": "d", "g": "none"} and buckets(some, "off") == {"f": None, "g": None}
    assert buckets(none, "auto") == {"g": None} and buckets(none, "on") == {"g": "none"}


def test_an_index_takes_the_mode(spark, tmp_path):
    from treedex.plans.index import KnowledgeIndex

    (tmp_path / "a.md").write_text("# A\n")
    for mode, want in (("on", "none"), ("off", None), ("auto", None)):
        ix = KnowledgeIndex.from_config(spark, config.from_dict({"directories": {"include": [str(tmp_path)]}, "output": {"partition_by_domain": mode}}))
        assert [r.domain for r in ix.file_domains.collect()] == [want]
