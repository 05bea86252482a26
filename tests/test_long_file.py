"""One file of a million nodes: trees, searches and counts end, and give what a stack gives."""

from pyspark.sql import functions as F

from treedex.operators import markdown, search, tree

N = 1_000_000


def test_a_million_nodes(spark):
    # levels 1, 2, 3, 3, 2, 3, 3, ... below a root every 1000 nodes
    level = F.when(F.col("id") % 1000 == 0, 1).when(F.col("id") % 3 == 1, 2).otherwise(3)
    text = F.when(F.col("id") % 1000 == 0, "alpha").when(F.col("id") % 3 == 1, "beta").otherwise(F.concat(F.lit("gamma "), (F.col("id") % 7).cast("string")))
    n = spark.range(N).select(F.lit("f").alias("file_path"), (F.col("id") + 1).alias("pre"), level.alias("level"), text.alias("text"))
    n = tree.intervals(n, levels=3).withColumn("search_text", F.col("text")).withColumn("node_type", F.when(F.col("level") == 1, "heading").otherwise("x"))
    # a root's nodes that match all lie below it: two terms find each once, a middle term its root's first match alone
    below = sum(1 for i in range(N) if i % 1000 and i % 3 != 1 and i % 7 == 5)
    assert search.search_sequence(n, ["alpha", "gamma 5"]).count() == below
    first = {}
    for i in range(N):
        if i % 1000 and i % 3 == 1:
            first.setdefault(i // 1000, i)
    inside = sum(sum(1 for j in (i + 1, i + 2) if j < N and j % 1000 and j // 1000 == i // 1000 and j % 7 == 5) for i in first.values())
    assert search.search_sequence(n, ["alpha", "beta", "gamma 5"]).count() == inside
    assert tree.descendant_counts(n).filter("n = 999").count() == N // 1000
    assert tree.depth_and_path(n, levels=3).agg(F.max("depth")).first()[0] == 3
    assert tree.nearest_heading(n, n.filter("pre % 50000 = 0").select("file_path", "pre"), levels=1).count() == N // 50000


def test_deep_lists(spark):
    """More levels than can be written out, and a stack agrees."""
    rows, want, stack = [], [], []
    for i in range(400):
        depth = (i * 7) % 90
        rows.append("  " * depth + f"- item {i}")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        want.append(stack[-1][1] if stack else None)
        stack.append((depth, i + 1))
    n = markdown.nodes(spark.createDataFrame([("a", "\n".join(rows)), ("b", "# h\n" + "\n".join(rows))], "file_path string, content string"))
    got = {f: [r.parent_pre for r in n.filter(F.col("file_path") == f).orderBy("pre").collect()] for f in "ab"}
    assert got["a"] == want and got["b"] == [None, *(1 if p is None else p + 1 for p in want)]
    assert n.filter("file_path = 'b' and pre = 1").first()["last"] == 401
