"""Held-out accuracy of the classifiers' queries, and the packing query's rows against encoding whole texts and the sources' shares."""

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from treedex.llm import common, queries, tokens

D = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def crc(x):
    return zlib.crc32(str(x).encode())


def test_language(spark):
    truth = {r.doc_id: r for r in common.table(spark, D, "documents").select("doc_id", "lang", "text").collect()}
    rows = queries.op1_language_id(spark, D).collect()
    assert len(rows) == len(truth) and all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    asked = [r for r in rows if r.held_out and truth[r.doc_id].lang and len((truth[r.doc_id].text or "").split()) >= 20]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in asked)
    print("language, held out:", right, "of", len(asked))
    assert len(asked) > 1000 and right >= 0.98 * len(asked)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id].text or "")) for r in rows)


def test_toxicity(spark):
    marks = {r.doc_id: r.toxic for r in common.table(spark, D, "labels").collect()}
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, D).collect()}
    assert len(rows) == common.table(spark, D, "documents").count() and all(r.held_out == (crc(d) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in rows.items())
    asked = [(marks[d], r.predicted) for d, r in rows.items() if r.held_out and marks.get(d) in (0, 1)]
    bad, good = [p for t, p in asked if t], [p for t, p in asked if not t]
    print("toxic, held out:", sum(bad), "of", len(bad), "clean called toxic:", sum(good), "of", len(good))
    # trained on some 390 marked documents; about one marked document in ten holds none of their words
    assert len(bad) >= 50 and sum(bad) >= 0.75 * len(bad) and sum(good) <= 0.03 * len(good)


def test_packing_rows(spark):
    d = "/root/testdata/sf0.01"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.tokenizer_path())
    docs = {r.doc_id: r for r in common.table(spark, d, "documents").collect()}
    ids = {i: np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for i, r in docs.items()}
    rows = queries.op10_packing(spark, d).collect()
    got = defaultdict(int)
    at = defaultdict(lambda: defaultdict(int))
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        got[r.doc_id] += r.length
        at[r.sequence_id][docs[r.doc_id].source] += r.length
    assert got == {i: len(x) for i, x in ids.items()}
    share = defaultdict(int)
    for i, x in ids.items():
        share[docs[i].source] += len(x)
    total = sum(share.values())
    full = [s for s in at.values() if sum(s.values()) == 4096]
    assert len(full) == total // 4096
    owed = defaultdict(float)
    for w in range(len(full)):
        for source, n in share.items():
            if n >= total / 256:
                owed[source] += 4096 * n / total - at[w][source]
                assert abs(owed[source]) <= 1.001  # what a window owes goes to the next
