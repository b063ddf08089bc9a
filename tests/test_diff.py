"""Diffs of any number of hunks against a plain search."""

import random

from pyspark.sql import functions as F

from rippleline.operators import diff

NODES = "id long, name string, schema string, kind string, chunk long"
EDGES = "id long, src long, dst long, kind string, path string, line int, provenance array<long>"
CHUNKS = "id long, service string, path string, kind string, title string, line_start int, line_end int, signature string, body string, node long"
FOUND = "pos int, file string, start int, end int"


def plain(hunks, edges, chunks):
    """{node: (file, lines, source)} of its first evidence: hunk, chunks before edges, id."""
    best = {}
    same = lambda a, b: (a.endswith(b) or b.endswith(a)) and a.split("/")[-1] == b.split("/")[-1]
    for pos, file, start, end in hunks:
        rows = [(c[9], (pos, 0, c[0]), c[2], "chunk overlap") for c in chunks if same(c[2], file) and end >= c[5] and start <= c[6]]
        rows += [(e[1], (pos, 1, e[0]), e[4], "edge path") for e in edges if e[3] != "Owns" and same(e[4], file)]
        for node, at, path, source in rows:
            if node is not None and (node not in best or at < best[node][0]):
                best[node] = (at, path, f"{start}-{end}", source)
    return {n: v[1:] for n, v in best.items()}


def case(r, n):
    folders = ["src", "rc", "service/orders/internal/app/src", "x/service/orders/internal/app/src", "lib/service/billing/internal/app"]
    path = lambda: "/".join([*([r.choice(folders)] if r.random() < 0.9 else []), r.choice(["main.rs", "a.go", "quite_a_long_name_of_a_file.cpp"])])
    ends = lambda: (lambda a: (a, a + r.choice([0, 0, 3, 700])))(r.choice([1, 5, 250, 256, 257, 1000, 5000]))
    hunks = [(i, path(), *ends()) for i in range(n)]
    chunks = [(i, "s", path(), "SqlProc", "t", *ends(), "", "", r.choice([None, *range(20)])) for i in range(30)]
    edges = [(i, 20 + r.randrange(20), 0, r.choice(["Calls", "Owns"]), path(), 1, []) for i in range(30)]
    return hunks, edges, chunks


def test_changed_symbols_by_brute_force(spark):
    nodes = spark.createDataFrame([(i, f"n{i}", None, "Service", None) for i in range(40)], NODES)
    for seed, n in ((1, 1), (2, 12), (3, 60)):
        hunks, edges, chunks = case(random.Random(seed), n)
        got = diff.changed_symbols(spark.createDataFrame(hunks, FOUND), nodes, spark.createDataFrame(edges, EDGES), spark.createDataFrame(chunks, CHUNKS)).collect()
        assert {x.node: (x.file, x.lines, x.source) for x in got} == plain(hunks, edges, chunks)


def test_a_large_diff_is_not_broadcast(spark):
    """A million hunks in a thousand files of one name."""
    found = spark.range(1_000_000).select(F.col("id").cast("int").alias("pos"), F.format_string("services/number%d/internal/main.rs", F.col("id") % 1000).alias("file"), (F.col("id") % 5000 * 10).cast("int").alias("start"), (F.col("id") % 5000 * 10 + 2).cast("int").alias("end"))
    chunks = spark.range(2000).select("id", F.lit("s").alias("service"), F.format_string("services/number%d/internal/main.rs", F.col("id") % 1000).alias("path"), F.lit("k").alias("kind"), F.lit("t").alias("title"), F.lit(101).alias("line_start"), F.lit(109).alias("line_end"), F.lit("").alias("signature"), F.lit("").alias("body"), F.col("id").alias("node"))
    stored = chunks.select("node", F.col("id").alias("evidence"), F.col("path").alias("stored"), "line_start", "line_end")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        met = diff._on_same_path(stored, found, True)
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
        # Lines 100-102 of a file are hunks of ids 10, 5010, ...: a file has them where its number is the id's rest by 1000.
        assert met.count() == 2 * sum(1 for i in range(1_000_000) if i % 5000 == 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_hunks_of_a_diff(spark):
    text = "diff --git a/x b/src/main.rs\n--- a/src/main.rs\n+++ b/src/main.rs\n@@ -1,2 +3,4 @@\n+x\n"
    assert [(x.file, x.start, x.end) for x in diff.hunks(spark, text).collect()] == [("src/main.rs", 3, 6)]
