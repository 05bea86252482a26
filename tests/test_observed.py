"""Fingerprints of large folders, table functions and the numbers of stages."""

import hashlib

import pytest
from pyspark.sql import functions as F

from treedex.config import Config
from treedex.operators import stale
from treedex.plans.index import KnowledgeIndex
from treedex.sources import mindmap
from treedex.timing import Counts

LISTED = "dir string, name string, length bigint, mtime_ns bigint"


def by_hand(rows):
    held = {}
    for d, name, length, time in rows:
        if name is not None and not name.startswith("."):
            held.setdefault(d, []).append((name.encode(), "" if length is None or time is None else f"{name},{length},{time}\n"))
    return {d: "sha256:" + hashlib.sha256("".join(x for _, x in sorted(v)).encode()).hexdigest() for d, v in held.items()}


def test_fingerprint_of_a_large_folder(spark):
    """One folder holds nearly all files, its names share prefixes, and no row holds them all."""
    f = spark.range(200_000).select(F.when(F.col("id") % 50 == 0, F.concat(F.lit("d"), F.col("id") % 7)).otherwise("hot").alias("dir"), F.concat(F.lit("n"), F.reverse(F.col("id").cast("string"))).alias("name"), F.col("id").alias("length"), (F.col("id") * 3).alias("mtime_ns"))
    got = stale.fingerprint(f)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    assert {r.dir: r.fingerprint for r in got.collect()} == by_hand(map(tuple, f.collect()))


def test_fingerprint_of_odd_rows(spark):
    rows = [("a", "x", 1, 2), ("a", "x", 1, 2), ("a", "é", 3, 4), ("a", "Z", 5, 6), ("a", ".h", 1, 1), (None, "x", 1, 1), (None, "b", None, 1), ("only hidden", ".x", 1, 1), ("c", "no size", None, None), ("", "x", 0, 0), ("c2", None, 1, 1), ("\U0001f600", "�", 1, 1), ("\U0001f600", "\U0001f600", 1, 1)]
    rows += [("same", "n", 1, 1)] * 3000  # more than one block of equal lines
    got = stale.fingerprint(spark.createDataFrame(rows, LISTED).repartition(5))
    assert {r.dir: r.fingerprint for r in got.collect()} == by_hand(rows)
    assert stale.fingerprint(spark.createDataFrame([], LISTED)).count() == 0


def test_fingerprint_names_its_folder(spark):
    f = spark.createDataFrame([("a", "x", 1, 2)], LISTED).withColumnRenamed("dir", "folder")
    assert stale.fingerprint(f, "folder").columns == ["folder", "fingerprint"]


MAP = '<map><node ID="R" TEXT="a"><node TEXT="b" TAGS="x y"/><node TEXT="c"><richcontent TYPE="NOTE"><html><body><p>n</p></body></html></richcontent></node></node></map>'


def test_map_function(spark):
    files = spark.createDataFrame([("m", MAP), ("broken", "<map>"), ("empty", ""), ("null", None), ("deep", "<map>" + '<node TEXT="x">' * 2000 + "</node>" * 2000 + "</map>")], "file_path string, content string")
    files.createOrReplaceTempView("some_files")
    mindmap.register(spark)
    got = spark.sql("SELECT f.file_path, n.* FROM some_files f, LATERAL mindmap_nodes(f.content) n")
    want = mindmap.nodes(files).select(got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = spark.sql("SELECT f.file_path FROM some_files f LEFT JOIN LATERAL mindmap_nodes(f.content) n ON TRUE WHERE n.pre IS NULL")
    assert sorted(r.file_path for r in none.collect()) == ["broken", "empty", "null"]


def test_map_function_takes_rich_text_from_below(spark):
    mindmap.register(spark)
    made = MAP.replace('"', "\\\"")
    assert [r.note for r in spark.sql(f'SELECT note FROM mindmap_nodes("{made}") ORDER BY pre').collect()] == ["", "", "n"]
    assert [r.note for r in spark.sql(f'SELECT note FROM mindmap_nodes("{made}", TRUE) ORDER BY pre').collect()] == ["n", "", "n"]


def test_numbers_of_stages(spark, tmp_path):
    (tmp_path / "a.md").write_text("# One\n\ntext #tag\n")
    (tmp_path / "b.md").write_text(" \n")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.mm").write_text(MAP)
    (tmp_path / "e.mm").write_text("no map")
    index = KnowledgeIndex.from_config(spark, Config([str(tmp_path)]))
    assert index.counts.stages["read"] == {"rows": 5, "bytes": sum(p.stat().st_size for p in tmp_path.iterdir()), "unreadable": 1, "blank": 1, "generated": 0}
    assert index.kept("invalid").count() == index.counts.stages["invalid"]["rows"] == 2
    assert index.nodes.count() == index.counts.stages["nodes"]["rows"]
    assert index.kept("tag").count() == index.counts.stages["tag"]["rows"]
    assert {(r.stage, r.number): r.n for r in index.counts.rows(spark).collect()}["read", "unreadable"] == 1


def test_numbers_of_nothing_and_of_clashing_names(spark):
    counts = Counts()
    assert counts.rows(spark).count() == 0
    counts.cut("none", spark.createDataFrame([], "rows bigint"), total=F.sum("rows"))
    assert counts.stages == {"none": {"rows": 0, "total": 0}}
    assert counts.cut("some", spark.range(3).withColumnRenamed("id", "rows"), total=F.sum("rows")).count() == 3
    assert counts.stages["some"] == {"rows": 3, "total": 3}
    with pytest.raises(ValueError, match="rows"):
        counts.cut("again", spark.range(3), rows=F.lit(1))
