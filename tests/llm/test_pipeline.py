"""The pipeline's stages one after the other on small tables, each held against a brute-force version on its own input."""

import os
import re
from collections import defaultdict
from itertools import combinations

import pytest

import corpus_pipeline
from treedex.llm import common, secrets, toxicity, token_output

D = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def similarities(docs):
    """Of each two documents that share a five-word shingle: the similarity of their sets."""
    of, sets, shared = defaultdict(list), {d: shingles(r["text"]) for d, r in docs.items()}, defaultdict(int)
    for d in sorted(sets):
        for s in sets[d]:
            of[s].append(d)
    for ids in of.values():
        for pair in combinations(ids, 2):
            shared[pair] += 1
    return {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contaminated(text, windows):
    w, hit = words(text), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def steps(spark):
    docs = common.table(spark, D, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, D), "test-" + name)
        out.append(docs)
    return out


def by_id(df):
    rows = {r.doc_id: r.asDict() for r in df.collect()}
    assert len(rows) == df.count()
    return rows


def test_columns(steps):
    assert all(s.schema == steps[0].schema for s in steps[1:-1])


def test_toxic(spark, steps):
    before, after = by_id(steps[0]), by_id(steps[1])
    model = toxicity.fit(steps[0], common.table(spark, D, "labels"))
    ids = sorted(before)
    keep = {d for d in ids if model.score([before[d]["text"]])[0] < 0.5}
    assert after == {d: before[d] for d in keep} and len(keep) < len(before)


def test_near_duplicates(steps):
    """Against exact similarities: copies go, nearly all pairs of 0.8 or more meet, and what goes had a document like it."""
    before, after = by_id(steps[1]), by_id(steps[2])
    assert len(after) < len(before) and all(before[d] == r for d, r in after.items())
    likes = similarities(before)
    near = [p for p, s in likes.items() if s >= 0.8]
    left = [p for p in near if p[0] in after and p[1] in after]
    assert len(near) > 20 and len(left) <= 0.05 * len(near)
    assert not any(likes[p] >= 0.9 for p in left)
    alike = {d for p, s in likes.items() if s >= 0.8 for d in p}
    assert set(before) - set(after) <= alike


def test_one_of_each_group(steps):
    """Groups by all pairs of a similarity of 0.8 or more whose fingerprints are near enough and agree on the bits of some cell, the smallest id of each."""
    import numpy as np

    from treedex.llm import simhash

    before, after = by_id(steps[1]), by_id(steps[2])
    ids = sorted(before)
    raw = [(before[d]["text"] or "").encode() for d in ids]
    fp = simhash.wide_fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    label = np.arange(len(ids))
    radius = simhash.wide_radius()
    cells = simhash.cell_keys(fp)
    near = [np.flatnonzero((simhash.distance(fp[i][None].repeat(len(ids), 0), fp) <= radius) & (cells == cells[:, i : i + 1]).any(0)) for i in range(len(ids))]
    sets = [shingles(before[d]["text"]) for d in ids]
    near = [[j for j in x if (fp[i] == fp[j]).all() or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i, x in enumerate(near)]
    while True:
        new = np.array([min(label[j] for j in x) for x in near])
        if (new == label).all():
            break
        label = new
    assert set(after) == {ids[i] for i in set(label.tolist())}


def test_decontaminated(spark, steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    windows = set()
    for r in common.table(spark, D, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    keep = {d for d, r in before.items() if not contaminated(r["text"], windows)}
    assert after == {d: before[d] for d in keep} and len(keep) < len(before)


def test_without_secrets(steps):
    before, after = by_id(steps[3]), by_id(steps[4])
    changed = 0
    for d, r in before.items():
        found = secrets.scan(r["text"] or "")
        text = secrets.redact(r["text"], found) if found else r["text"]
        changed += bool(found)
        assert after[d] == r | {"text": text, "n_chars": len(text) if found else r["n_chars"]}
    assert set(after) == set(before) and changed


def test_packed(steps):
    from tokenizers import Tokenizer

    e = Tokenizer.from_file(token_output.tokens.tokenizer_path())
    before, parts, used = by_id(steps[4]), defaultdict(list), defaultdict(int)
    for r in steps[5].collect():
        ids = bytes(r["ids"])
        assert len(ids) == 4 * r["length"]
        parts[r["doc_id"]].append((r["start"], ids))
        used[r["sequence_id"]] += r["length"]
    assert all(n <= 4096 for n in used.values())
    for d, r in before.items():
        ids = e.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert b"".join(x for _, x in sorted(parts[d])) == b"".join(i.to_bytes(4, "little") for i in ids)
    assert set(parts) == set(before)


def test_null_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for t in ("benchmark", "labels"):
        common.table(spark, D, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for _, stage in corpus_pipeline.STAGES:
        for now in (docs, docs.limit(0)):
            assert stage(spark, now, str(tmp_path)).count() <= 4
