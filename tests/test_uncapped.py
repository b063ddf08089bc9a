"""Searches without a cap, and answers that ask for more than the usual cap."""

import re

from hypothesis import HealthCheck, given, settings

from rippleline import serve
from rippleline.api import Engine
from rippleline.operators import adjacency, graph
from rippleline.sources.store import Store
from tests.test_graph import NODES, fifo, graphs, steps_of, table


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(graphs)
def test_all_reached_is_the_search_without_cap(spark, drawn):
    drawn, start, depth, mode, weak, origin, _ = drawn
    edges = [(i, *e) for i, e in enumerate(drawn)]
    got = sorted(map(tuple, graph.all_reached(steps_of(table(spark, edges), mode, weak, origin), start, depth).collect()))
    assert got == [(i + 1, *r) for i, r in enumerate(fifo(edges, start, depth, mode, weak, origin, 10**9))]


def _star(spark, n):
    """A procedure that a procedure calls and n services invoke, the last of which comes in by a second level."""
    kinds = [(0, "P", None, "Procedure", None), (1, "Q", None, "Procedure", None), *[(i + 2, f"S{i}", None, "Service", None) for i in range(n)]]
    edges = [(0, 1, 0, "Calls", "q", 1, []), *[(i + 1, i + 2, 0 if i < n - 1 else 1, "Invokes", "s", i, []) for i in range(n)]]
    return Store(spark.createDataFrame(kinds, NODES), spark.createDataFrame(edges, "id long, src long, dst long, kind string, path string, line int, provenance array<long>"), *[spark.createDataFrame([], "x int")] * 4)


def test_engine_without_cap(spark, tmp_path):
    store = _star(spark, 301)
    adjacency.write(store.edges, str(tmp_path / "a"))
    kept = Store(**{**store.__dict__, "steps": adjacency.read(spark, str(tmp_path / "a"))})
    for s in (store, kept):
        e = Engine(spark, store=s)
        assert e.callers("p", 2).count() == 200
        for found in (e.callers("p", 2, cap=None), e.impact("p", 2, cap=None)):
            rows = [(r.ord, r.key, r.depth) for r in found.collect()]
            assert [r[0] for r in rows] == list(range(1, 303)) and rows[0][1:] == ("Q", 1) and rows[-1][1:] == ("S300", 2)
        assert [r.key for r in e.callers("p", 2, cap=250).collect()] == ["Q", *[f"S{i}" for i in range(249)]]


def test_tools_give_as_many_as_asked(spark):
    e = Engine(spark, store=_star(spark, 301))

    def said(tool, **arguments):
        return serve.answer(e, {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": {"name": "p", **arguments}}})["result"]["content"][0]["text"]

    assert len(said("get_callers", max_results=1000).split("\n")) == 301
    assert len(said("get_callers").split("\n")) == 50
    assert said("get_impact", depth=1, max_results=1) == "d1: [Q:Procedure via:Calls]"
    assert re.search(r"\n\(cap hit\)", said("get_impact", depth=1)) and "cap hit" not in said("get_impact", depth=1, max_results=1000)


def test_near_of_the_tree_has_no_cap(spark, tmp_path):
    """tree_callers of a tree with more services than the cap."""
    import duckdb
    import os

    from rippleline.plans import catalogue, extraction  # noqa: F401

    src, out = "/root/testdata/sf0.001", str(tmp_path)
    n = duckdb.connect()
    n.execute(f"copy (select range::INTEGER + 1 as s_suppkey, 'Supplier ' || range as s_name, 3::INTEGER as s_nationkey from range(230)) to '{out}/supplier.parquet' (format parquet)")
    os.symlink(f"{src}/nation.parquet", f"{out}/nation.parquet")
    for t in ("supplier", "nation"):
        n.execute(f"create view {t} as select * from '{out}/{t}.parquet'")
    want = n.sql(catalogue.ORACLE_SQL["tree_callers"]).fetchall()
    got = catalogue.QUERIES["tree_callers"](spark, out).collect()
    assert len(want) == 231 and sorted(map(tuple, got)) == sorted(want)
