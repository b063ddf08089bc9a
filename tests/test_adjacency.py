"""The adjacency that a store keeps: same answers as steps made from edges, without moving or writing steps for a query."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from test_graph import KINDS, fifo, table

from rippleline.operators import adjacency, graph
from rippleline.runtime import shared_dir


def made(spark, rows, path, hub=adjacency.HUB):
    adjacency.write(table(spark, rows), str(path), hub)
    return adjacency.read(spark, str(path))


def walk_of(steps, mode, weak, origin=()):
    return {"down": steps.downstream, "up": steps.upstream}[mode](weak) if mode != "impact" else steps.impact(weak, origin)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hub,seed", [(1 << 17, 1), (3, 2)])
def test_searches_equal_a_plain_one(spark, tmp_path, hub, seed):
    """With nodes of more than three steps dealt to several slots, as with none."""
    r = random.Random(seed)
    rows = [(i, r.randrange(25), r.randrange(25), r.choice(KINDS), [r.randrange(3)] if r.random() < 0.4 else []) for i in range(120)]
    steps = made(spark, rows, tmp_path / "a", hub)
    assert (steps.hubs is None) == (hub > 3)
    for mode, weak, origin, start, cap in (("down", False, (), 3, 200), ("up", True, (), 7, 5), ("impact", False, (1,), 5, 200), ("impact", True, (0, 2), 11, 7), ("impact", False, (), 99, 200)):
        assert graph.first_reached(walk_of(steps, mode, weak, origin), start, 4, cap) == fifo(rows, start, 4, mode, weak, origin, cap)
    tables = {0: [], 5: [1], 7: [0, 2], 24: [2], 99: []}
    starts = spark.createDataFrame(list(tables.items()), "origin long, tables array<long>")
    got = {}
    for x in graph.first_reached_of_each(steps.impact(), starts, 4, 9).orderBy("origin", "ord").collect():
        got.setdefault(x.origin, []).append((x.node, x.via, x.depth))
    assert got == {s: f for s, t in tables.items() if (f := fifo(rows, s, 4, "impact", False, t, 9))}
    reached = graph.reach(steps.impact(), starts.select("origin", F.col("origin").alias("node")), 4)
    assert {(x.origin, x.node): x.depth for x in reached.collect()} == {(s, n): d for s in tables for n, _, d in fifo(rows, s, 4, "impact", False, cap=10**6)}
    nodes = spark.createDataFrame([(i, f"n{i}", None, "Procedure" if i % 2 else "Service", None) for i in range(25)], "id long, name string, schema string, kind string, chunk long")
    for n in range(4):
        assert graph.origin_tables(nodes, steps, n) == graph.origin_tables(nodes, table(spark, rows), n)
    steps.close()


def test_a_join_moves_the_frontier_only(spark, tmp_path, monkeypatch):
    rows = [(i, i % 500, i * 7 % 500, "Calls", []) for i in range(3000)]
    steps = made(spark, rows, tmp_path / "a")
    frontier = spark.range(500).select(F.col("id").alias("node"))
    monkeypatch.setattr(adjacency, "SEEK", 0)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = steps.upstream().join(frontier, 500)
        text = plan(joined)
        assert joined.count() == len([x for x in rows if x[1] != x[2]])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    side = text.split("SortMergeJoin")[1]
    assert text.count("Exchange") == 1 and side.index("Exchange") < side.index("FileScan") and "Bucketed: true" in side


def test_a_few_nodes_are_looked_up_by_bucket(spark, tmp_path):
    steps = made(spark, [(i, i % 500, i * 7 % 500, "Calls", []) for i in range(3000)], tmp_path / "a")
    few = steps.upstream().of([17])
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a partition a file
    try:
        assert few.rdd.getNumPartitions() == 1 < steps.rows.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(x.nxt for x in few.collect()) == sorted(i % 500 for i in range(3000) if i * 7 % 500 == 17 and i % 500 != 17)


def test_no_query_writes_steps(spark, tmp_path):
    steps = made(spark, [(i, r, r + 1, "Calls", []) for i, r in enumerate(range(50))], tmp_path / "a")
    listed = lambda: {os.path.basename(f).split("-")[0] for f in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/*")} - was
    was = {os.path.basename(f).split("-")[0] for f in glob.glob(f"{shared_dir(spark).removeprefix('file:')}/tables/*")} - {"frontier"}
    starts = spark.createDataFrame([(49, 49)], "origin long, node long")
    assert graph.reach(steps.upstream(), starts, 3).count() == 3
    assert listed() <= {"frontier"}


def test_a_hub_is_spread(spark, tmp_path):
    """A node with half of all steps: no bucket gets much more than its share."""
    n = 20_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).cast("long").alias("src"), (F.col("id") + n).alias("dst"), F.lit("Calls").alias("kind"), F.array().cast("array<long>").alias("provenance"))
    adjacency.write(rows, str(tmp_path / "a"), 500)
    steps = adjacency.read(spark, str(tmp_path / "a"))
    assert [(x.cur, x.parts) for x in steps.hubs.collect()] == [(0, 20)]
    each = [x["count"] for x in steps.rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(each) == 2 * n and max(each) < 1.4 * sum(each) / len(each)
    assert steps.downstream().of([0]).count() == n // 2


def test_tasks_hand_on_no_more_than_the_cap(spark):
    """A star of a million leaves from one origin: the ranking window reads at most cap rows of each task."""
    star = spark.range(1_000_000).select(F.lit(0).cast("long").alias("cur"), (F.col("id") + 1).alias("nxt"), F.lit(0).alias("dir"), F.col("id").alias("edge_id"), F.array().cast("array<long>").alias("needs"))
    starts = spark.createDataFrame([(0, [])], "origin long, tables array<long>")
    got = graph.first_reached_of_each(star, starts, 1, 200)
    assert sorted((x.ord, x.node, x.via) for x in got.collect()) == [(i + 1, i + 1, i) for i in range(200)]
    window = graph.top_of_each(spark.range(10).selectExpr("id % 2 AS origin", "id AS at", "id % 3 AS had"), 3)
    text = plan(window)
    assert text.index(", 3, Final") < text.index("Exchange hashpartitioning(origin") < text.index(", 3, Partial")
