"""Traversal against a plain first-in first-out search."""

from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rippleline.operators import graph

KINDS = ["Calls", "Touches", "Publishes", "Consumes", "Owns", "Invokes"]
EDGES = "id long, src long, dst long, kind string, path string, line int, provenance array<long>"
NODES = "id long, name string, schema string, kind string, chunk long"


def fifo(edges, start, depth, mode, weak, origin=(), cap=graph.CAP):
    """[(node, via, depth)]: outgoing edges by id, then incoming ones."""
    found, seen, queue = [], {start}, deque([(start, 0)])
    while queue:
        node, d = queue.popleft()
        if d >= depth or len(found) >= cap:
            continue
        steps = [(e, e[2], "out") for e in edges if e[1] == node] + [(e, e[1], "in") for e in edges if e[2] == node]
        for (i, src, dst, kind, prov), nxt, side in steps:
            if src == dst or (kind == "Owns" and not weak) or nxt in seen:
                continue
            forward = {"down": True, "up": False}.get(mode, kind == "Publishes")
            if (side == "out") != forward:
                continue
            if mode == "impact" and kind == "Publishes" and origin and prov and not set(origin) & set(prov):
                continue
            seen.add(nxt)
            found.append((nxt, i, d + 1))
            if len(found) >= cap:
                break
            queue.append((nxt, d + 1))
    return found[:cap]


def table(spark, edges):
    return spark.createDataFrame([(i, s, d, k, "p", 1, list(p)) for i, s, d, k, p in edges], EDGES)


def steps_of(df, mode, weak, origin=()):
    if mode == "down":
        return graph.downstream_steps(df, weak)
    if mode == "up":
        return graph.upstream_steps(df, weak)
    return graph.impact_steps(df, weak, graph.origin_column(origin, df))


graphs = st.integers(1, 14).flatmap(
    lambda n: st.tuples(
        st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.sampled_from(KINDS), st.lists(st.integers(0, 3), max_size=2)), max_size=40),
        st.integers(0, n), st.integers(0, 5), st.sampled_from(["down", "up", "impact"]), st.booleans(), st.lists(st.integers(0, 3), max_size=2), st.sampled_from([3, 200]),
    )
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(graphs)
def test_order_depth_via_and_cap(spark, case):
    rows, start, depth, mode, weak, origin, cap = case
    edges = [(i, s, d, k, p) for i, (s, d, k, p) in enumerate(rows)]
    got = graph.first_reached(steps_of(table(spark, edges), mode, weak, origin), start, depth, cap)
    assert got == fifo(edges, start, depth, mode, weak, origin, cap)
    assert len(got) <= cap and start not in {n for n, _, _ in got} and len({n for n, _, _ in got}) == len(got)


@pytest.mark.parametrize("cap", [3, 200])
def test_searches_of_many_starts_at_once(spark, cap):
    """Each origin's order, depth, edges, guard and cap are those of its own search."""
    import random

    r = random.Random(cap)
    rows = [(i, r.randrange(30), r.randrange(30), r.choice(KINDS), [r.randrange(3)] if r.random() < 0.4 else []) for i in range(120)]
    tables = {0: [], 5: [1], 7: [0, 2], 29: [2], 99: []}
    starts = spark.createDataFrame(list(tables.items()), "origin long, tables array<long>")
    got = {}
    for x in graph.first_reached_of_each(graph.guarded_steps(table(spark, rows)), starts, 4, cap).orderBy("origin", "ord").collect():
        got.setdefault(x.origin, []).append((x.node, x.via, x.depth))
    assert got == {s: f for s, t in tables.items() if (f := fifo(rows, s, 4, "impact", False, t, cap))}


def test_uncapped_reach_of_many_starts(spark):
    import random

    r = random.Random(1)
    edges = [(i, r.randrange(60), r.randrange(60), r.choice(KINDS), []) for i in range(150)]
    starts = spark.createDataFrame([(s, s) for s in (0, 5, 59, 99)], "origin long, node long")
    got = {(x.origin, x.node): x.depth for x in graph.reach(steps_of(table(spark, edges), "impact", False), starts, 4).collect()}
    want = {(s, n): d for s in (0, 5, 59, 99) for n, _, d in fifo(edges, s, 4, "impact", False, cap=10**6)}
    assert got == want


@pytest.mark.parametrize("tables,want", [((5,), {1, 2}), ((0,), {1, 2, 3, 4}), ((), {1, 2, 3, 4})])
def test_provenance_guard(spark, tables, want):
    edges = [(0, 1, 0, "Touches", []), (1, 2, 1, "Invokes", []), (2, 2, 3, "Publishes", tables), (3, 4, 3, "Consumes", [])]
    nodes = spark.createDataFrame([(0, "T0", None, "Table", None), (1, "P", None, "Procedure", None), (2, "a", None, "Service", None), (3, "t", None, "Topic", None), (4, "b", None, "Service", None), (5, "T5", None, "Table", None)], NODES)
    df = table(spark, edges)
    assert graph.origin_tables(nodes, df, 0) == [0] and graph.origin_tables(nodes, df, 1) == [0] and graph.origin_tables(nodes, df, 2) == []
    assert {n for n, _, _ in graph.first_reached(steps_of(df, "impact", False, graph.origin_tables(nodes, df, 0)), 0, 5)} == want


def test_topic_reaches_consumers_only(spark):
    df = table(spark, [(0, 1, 0, "Publishes", []), (1, 2, 0, "Consumes", []), (2, 1, 3, "Owns", [])])
    assert graph.first_reached(steps_of(df, "impact", False), 0, 1) == [(2, 1, 1)]
    assert graph.first_reached(steps_of(df, "impact", False), 3, 1) == []
    assert graph.first_reached(steps_of(df, "impact", True), 3, 1) == [(1, 2, 1)]
    assert graph.first_reached(steps_of(df, "impact", False), 1, 0) == [] == graph.first_reached(steps_of(df, "impact", False), 77, 3)


def test_bridges_and_degree(spark):
    nodes = spark.createDataFrame([(0, "a", None, "Service", None), (1, "b", None, "Service", None), (2, "t1", None, "Topic", None), (3, "t2", None, "Topic", None)], NODES)
    edges = table(spark, [(0, 0, 2, "Publishes", [9]), (1, 1, 2, "Consumes", []), (2, 0, 3, "Publishes", []), (3, 1, 3, "Consumes", [])])
    one = graph.bridge_summary(graph.bridges(edges, nodes)).first()
    assert (one.bridges, one.guarded, one.coarse) == (2, 1, ["t2"]) and one.summary.startswith("2 producer→consumer; 1 guarded, 1 COARSE (") and one.summary.endswith(": [t2]")
    none = graph.bridge_summary(graph.bridges(edges.where("kind = 'Consumes'"), nodes)).first()
    assert none.summary == "none"
    assert graph.bridge_summary(graph.bridges(edges.where("dst = 2"), nodes)).first().summary == "1 producer→consumer, all provenance-guarded"
    assert {r.node: (r.n_in, r.n_out) for r in graph.degrees(edges).collect()} == {0: (0, 2), 1: (0, 2), 2: (2, 0), 3: (2, 0)}
    ends = graph.topic_ends(edges, nodes, 2).first()
    assert (ends.producers, ends.consumers) == ("a (p:1)", "b (p:1)")


def test_ids_and_edges_need_no_single_partition(spark, tmp_path):
    """Ids are dense and in order over many partitions, and no exchange of rows goes to one."""
    rows = spark.range(0, 5000, 1, 7).selectExpr("cast((id * 7919) % 5000 as string) k", "(id * 31) % 5000 at")
    made = graph.numbered(rows, ["at", "k"])
    assert [x.id for x in made.orderBy("at", "k").collect()] == list(range(5000))
    assert "SinglePartition" not in made._jdf.queryExecution().toString()
    assert graph.numbered(rows.limit(0), ["at"]).count() == 0


def test_first_of_each_key_and_dense_ids(spark):
    rows = spark.createDataFrame([("x", 5, "late"), ("y", 1, "only"), ("x", 2, "first"), ("z", 9, None)], "k string, at int, v string").withColumn("o", F.col("at"))
    assert {r.k: r.v for r in graph.rank_first(rows, ["k"], ["o"]).collect()} == {"x": "first", "y": "only", "z": None}
    assert {r.k: r.id for r in graph.dense_ids(rows, "k", "at").collect()} == {"y": 0, "x": 1, "z": 2}
