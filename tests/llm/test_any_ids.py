"""Language, token files and packing on tables whose ids are texts, and the language kernel against sets of n-grams."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from treedex.llm import common, language, packing, token_output

TEXTS = {"en": "the cat and the dog went to the {} of the town and saw that it was good", "de": "der Hund und die Katze gingen zu dem {} in der Stadt und sahen dass es gut war", "fr": "le chat et le chien sont allés vers {} de la ville et ont vu que c'était bon"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"id-{x}-{i:03d}", t.format("w" * (i % 7) + str(i)) * (1 + i % 3), x, f"s{i % 3}") for x, t in TEXTS.items() for i in range(60)]
    return spark.createDataFrame([*rows, ("null", None, "en", "s"), (None, "the end", None, None), ("num", "12", "de", "s")], "doc_id string, text string, lang string, source string").repartition(3)


def test_language(docs):
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert got["null"].lang_pred == got["num"].lang_pred == "und" and got[None].lang_pred == "en" and not got[None].held_out
    assert all(r.lang_pred == r.doc_id.split("-")[1] and r.held_out == (zlib.crc32(r.doc_id.encode()) % 4 == 2) for r in got.values() if r.doc_id and r.doc_id.startswith("id-"))


def brute(texts, langs, marks, asked):
    """Scores by sets of n-grams of characters (each letter of these texts has a code of its own) and a dense regression."""

    def ngrams(t):
        s = ""
        for c in t.lower():
            c = c if c.isalpha() else " "
            s += "" if c == " " and s.endswith(" ") else c
        return {s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} - {" "}

    def k(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    land = [ngrams(texts[i]) for i in marks]
    gram = np.array([[k(a, b) for b in land] for a in land])
    w, v = np.linalg.eigh(gram + 1e-8 * np.eye(len(land)))
    root = (v / np.sqrt(np.maximum(w, 1e-8))) @ v.T
    phi = np.array([[k(ngrams(t), b) for b in land] for t in texts]) @ root
    names = sorted(set(langs))
    y = np.array([[1.0 if x == z else -1.0 for z in names] for x in langs])
    weight = np.array([1 / langs.count(x) for x in langs])
    mean, target = np.average(phi, 0, weight), np.average(y, 0, weight)
    beta = np.linalg.solve((phi - mean).T @ ((phi - mean) * weight[:, None]) + language.RIDGE * np.eye(len(land)), ((phi - mean) * weight[:, None]).T @ (y - target))
    s = np.array([[k(ngrams(t), b) for b in land] for t in asked]) @ root @ beta + target - mean @ beta
    return [names[i] for i in s.argmax(1)], ((s.max(1) + 1) / 2).clip(0, 1)


def test_kernel_against_sets():
    rng = np.random.default_rng(0)
    langs = [x for x in TEXTS for _ in range(30 if x == "en" else 12)]
    texts = [TEXTS[x].format("".join(rng.choice(list("abcdefg"), 5))) for x in langs]
    model = language.Model(texts, langs, seed=3)
    order = np.random.default_rng(3)
    marks = [i for x in sorted(TEXTS) for i in order.permutation(np.flatnonzero(np.array(langs) == x))[: language.LANDMARKS]]
    asked = ["the dog", "die Stadt war gut", "la ville", "x", "dog Hund chien", "a-b c", TEXTS["en"] * 300]
    want, score = brute(texts, langs, marks, asked)
    got, found = model.score(asked)
    assert got == want and np.allclose(found, score, atol=2e-4)


def test_a_sample_of_long_texts(spark):
    """Many languages of long texts: the driver gets gram sets of landmarks and kernel rows, no text."""
    letters = "abcdefghijklmnopqrst"
    rows = [(i * 100 + j, " ".join(letters[(i * 7 + k * (1 + i % 5) + j) % 20] + letters[(i + k) % 20] + letters[i] for k in range(20_000)), f"l{i:02d}") for i in range(20) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.fit(docs)
    assert len(model.languages) == 20
    got = language.predict(docs, model).join(docs, "doc_id")
    assert got.filter("lang = lang_pred").count() > 0.95 * len(rows)


def test_token_files_and_packing(spark, docs):
    path = common.shared_path(spark, "any-ids")
    token_output.write(docs, path)
    got = token_output.digests(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(r.doc_id for r in docs.filter("doc_id is not null").collect())
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    whole = {r.doc_id: r for r in packing.pack(docs).filter(F.col("length") == F.col("doc_tokens")).collect()}
    assert len(whole) > 100 and all(whole[r.doc_id].ids_crc32 == r.ids_crc32 for r in got if r.doc_id in whole)
