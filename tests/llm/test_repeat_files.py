"""The tables that op2 writes between its steps have few files, however many shuffle partitions there are, and its result is that of every window compared."""

import random
from collections import Counter

from treedex.llm import common, repeats


def test_few_files(spark, monkeypatch):
    pick = random.Random(5)
    line = "".join(pick.choice("abcdefgh ") for _ in range(260))
    texts = [(i, "".join(pick.choice("abcdefgh ") for _ in range(pick.randint(0, 300))) + line[i % 7 :] * (i % 3 > 0) + str(i) * 9) for i in range(60)]
    files = {}

    def written(df, tag, real=common.written):
        out = real(df, tag)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "written", written)
    monkeypatch.setattr(repeats, "HOT", 4)
    held = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.n_removed for r in repeats.repeats(spark.createDataFrame(texts, "doc_id bigint, text string"), text=False).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    n = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    assert got == {k: len({j for i in range(len(t) - 199) if n[t[i : i + 200]] > 1 for j in range(i, i + 200)}) for k, t in texts} and any(got.values())
    assert "halves" in files and max(files.values()) <= 4 * spark.sparkContext.defaultParallelism, files
