"""Cells of more bands hold the same links, and their keys grow with the table."""

import numpy as np
import pytest

from treedex.llm import simhash


@pytest.fixture(scope="module")
def prints():
    """Fingerprints in chains of up to 6 flipped bits, with the extremes."""
    rng = np.random.default_rng(5)
    out = [np.uint64(0), np.uint64((1 << 64) - 1), np.uint64(1 << 63)]
    for _ in range(150):
        x = rng.integers(0, 1 << 64, dtype=np.uint64)
        for _ in range(3):
            out.append(x)
            for b in rng.permutation(64)[: rng.integers(1, 7)]:
                x = x ^ np.uint64(1 << int(b))
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("agree", [2, 3, 4])
def test_same_links(spark, prints, agree):
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= simhash.RADIUS
    want = np.arange(len(prints))
    while True:
        low = np.array([want[row].min() for row in near])
        if (low == want).all():
            break
        want = low
    got = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp bigint"), agree=agree).collect()
    place, label = {int(x): i for i, x in enumerate(prints.view(np.int64))}, np.arange(len(prints))
    edges = [(place[r.a], place[r.b]) for r in got]
    while True:
        before = label.copy()
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if (label == before).all():
            break
    assert (label == want).all()


def test_keys_grow_with_the_table():
    assert [simhash.key_bands(n, 4) for n in (0, 10_000, 1 << 21)] == [2, 2, 2]
    more = [simhash.key_bands(1 << b, 4) for b in range(21, 42)]
    assert more == sorted(more) and more[-1] > 3
    # nodes that meet a node in its cells: a few hundred a choice of bands, where two bands would have a million
    for b in range(21, 42):
        m = simhash.key_bands(1 << b, 4)
        assert 2 ** (b - 64 * m / (4 + m)) < 1000
