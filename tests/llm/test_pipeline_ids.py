"""The near-duplicate stage on null and repeated ids: distinct texts stay, copies go."""

import random

import corpus_pipeline


def prose(seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(80))


def test_null_and_repeated_ids(spark):
    a, b, c, d, e, f, g = map(prose, range(7))
    rows = [(None, a, "n"), (None, b, "n"), (None, b, "n"), (0, c, "z"), (None, c, "n"), (5, d, "x"), (5, e, "x"), (5, e, "x"), (3, d, "y"), (None, "", "n"), (None, None, "n"), (8, f, "x"), (8, g, "x"), (9, f.upper(), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(not t for _, t, _ in got) == 1
    assert sorted((r for r in got if r[1]), key=str) == sorted([(None, a, "n"), (None, b, "n"), (0, c, "z"), (5, e, "x"), (3, d, "y"), (8, f, "x"), (8, g, "x")], key=str)
