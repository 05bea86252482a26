"""Corpora of more languages than have full samples."""

import random

from treedex.llm import language, sampling


def test_every_label_is_sampled(spark):
    rows = spark.createDataFrame([(i, f"l{i % 150}") for i in range(15_000)] + [(20_000, "rare"), (20_001, None)], "doc_id bigint, lang string")
    got = sampling.by_label(rows, "lang", 10, 1).collect()
    assert {r.lang for r in got} == {f"l{i}" for i in range(150)} | {"rare"}
    assert len(got) < 1.5 * 64 * 10


def test_languages_after_the_64th(spark):
    r = random.Random(3)
    words = {f"l{n:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for n in range(80)}
    rows = [(i, " ".join(r.choices(words[f"l{i % 80:02}"], k=40)), f"l{i % 80:02}") for i in range(80 * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    assert model.languages == sorted(words)
    got = {x.doc_id: x.lang_pred for x in language.predict(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) > 0.95 * len(rows)
