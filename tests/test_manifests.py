"""Manifests are parsed once each, by several tasks, and as PyYAML reads them."""

import yaml
from treedex.plans import catalogue
from treedex.sources import files as source


def test_mapping_as_safe_load():
    texts = ["a: [x, 'y?']\nb: {c: 2024-01-02}\n", "a: {x?y: 1}\n", "a: {b:{c: 1}}\n", "a:\tb\n", "a\t: b\n", "a: !\n", "k: \ufeffv\n", "a: [b\n", "- a\n", "", "a: yes\nn: 017\nc: 1:30\n", "a: &x [1]\nb: *x\n", "é: ß\n", "a: ['*.tmp',b?']\n"]
    for t in [*texts, "cards:\n" + "- {slug: a, source: [https://x.y, ../n.md]}\n" * 2000]:
        try:
            v = yaml.safe_load(t)
        except yaml.YAMLError:
            v = None
        assert source._mapping(t) == (v if isinstance(v, dict) else {}), t


def test_plain_manifests_by_libyaml(monkeypatch):
    def slow(_):
        raise AssertionError("read by PyYAML's own parser")

    monkeypatch.setattr(yaml, "safe_load", slow)
    assert source._mapping("version: 1\ncards:\n- {slug: a, source: [https://x.y, '[x](</abs/x.md>)'], source_hash: 'sha256:1'}\n")["cards"][0]["source_hash"] == "sha256:1"


def test_parsed_once_by_several_tasks(spark, tmp_path):
    spark.createDataFrame([(7, 3), (7, 3), (8, 4)], "p_partkey bigint, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.manifests(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("MapInPandas") == 1 and "REPARTITION_BY_NUM" in plan
    rows = found.collect()  # the SQL gives each row of part its own
    assert len(rows) == 9 and sorted({(r.dir, r.fingerprint, r.pos, r.source, r.source_hash) for r in rows if r.pos < 2}) == [(f"/kb/{k}", f"sha256:{f}", i, f"/kb/{k}/n.md" if i == 0 else "/abs/x.md", f"sha256:{i}") for k, f in ((7, 3), (8, 4)) for i in (0, 1)]
