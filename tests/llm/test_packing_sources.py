"""Sources too small for a queue of their own keep their share of every stretch."""

from collections import Counter, defaultdict

import numpy as np

from treedex.llm import packing


def packed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = packing.pack(docs).collect()
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    for pieces in (*seqs.values(), *([x[:2] for x in v] for v in by_doc.values())):
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
    assert set(by_doc) == {r[0] for r in rows} and all(sum(x[1] for x in v) == v[0][2] for v in by_doc.values())
    source = {r[0]: r[2] for r in rows}
    size, at = Counter(), defaultdict(Counter)
    for r in got:
        size[r.sequence_id] += r.length
        at[source[r.doc_id]][r.sequence_id] += r.length
    begin = dict(zip(sorted(size), np.cumsum([0, *(size[q] for q in sorted(size))]).tolist()))
    total = sum(size.values())
    #: for each source, the part of its tokens in the first half of all sequences
    half = {s: sum(n for q, n in c.items() if begin[q] + size[q] / 2 < total / 2) / sum(c.values()) for s, c in at.items()}
    return half, at


def words(n):
    return "lorem ipsum dolor sit amet " * n


def test_many_equal_sources(spark):
    half, _ = packed(spark, [(s * 20 + i, words(6), f"s{s}") for s in range(300) for i in range(20)])
    assert len(half) == 300 and min(half.values()) > 0.3 and max(half.values()) < 0.7


def test_a_hot_source_with_small_ones(spark):
    half, _ = packed(spark, [(i, words(40), "hot") for i in range(500)] + [(1000 + s * 20 + i, words(3), f"s{s}") for s in range(300) for i in range(20)])
    assert len(half) == 301 and min(half.values()) > 0.3 and max(half.values()) < 0.7


def test_a_rest_too_small_for_every_window(spark):
    """It shares the smallest large source's queue, and is dealt over all of it."""
    rows = [(1000 + i, words(40), "big") for i in range(500)] + [(i, "a", "x") for i in range(20)]
    half, at = packed(spark, rows)
    assert 0.3 < half["x"] < 0.7 and len(at["x"]) >= 10


def test_sources_of_one_document(spark):
    half, _ = packed(spark, [(i, words(20), f"s{i}") for i in range(400)] + [(400 + i, words(2), "t" if i % 2 else None) for i in range(20)])
    assert 0.3 < np.mean([half[f"s{i}"] for i in range(400)]) < 0.7 and 0.25 < half["t"] < 0.75
