"""From a configuration to answers, on a small tree."""

import argparse
import os

import pytest

from rippleline import cli, render
from rippleline.api import Engine, NotFound
from rippleline.operators.scan import table_function
from rippleline.sources import config, store
from rippleline.streaming import ingest

CORE = """CREATE PROCEDURE PLACE_ORDER AS
BEGIN
  EXECUTE IMMEDIATE 'INSERT INTO torder VALUES (1)';
  BEGIN CHECK_LIMIT(1); END;
END;
CREATE PROCEDURE CHECK_LIMIT AS
BEGIN NULL; END;
"""
RISK = 'const In = "orders"\nfunc run() {\n c.AddConsumeTopics(In, unknown)\n r := kgo.Record{Topic: "alerts"}\n db.Exec("PLACE_ORDER")\n db.Exec("NO_SUCH_PROC")\n rdb.Set(ctx, "risk:limit", 1)\n}\n'
GATE = 'fn f() {\n FutureRecord::to("orders");\n con.get::<_, String>("risk:limit");\n}\n'
BRIDGE = 'c.subscribe({"alerts"});\np.produce("settled", 1);\n'


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for name, text in (("db/a.sql", CORE), ("risk/a.go", RISK), ("gate/a.rs", GATE), ("bridge/a.cpp", BRIDGE)):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    (root / "out").mkdir()
    (root / "out/core-dependencies.csv").write_text("name,type,ref_name,ref_type\nCHECK_LIMIT,PROCEDURE,TLIMIT,TABLE\n")
    (root / "topics.toml").write_text('[settle]\nconsumes = ["settled"]\n[risk]\npublishes = ["alerts"]\n[risk.provenance]\nalerts = ["TORDER", "NOPE"]\n')
    sources = "".join(f'[[sources]]\nkind = "{k}"\npath = "{p}"\nservice = "{s}"\n' for k, p, s in (("sql", "db", "core"), ("code", "risk", "risk"), ("code", "gate", "gate"), ("code", "bridge", "bridge")))
    (root / "rippleline.toml").write_text(f'[store]\npath = "out/store"\n{sources}')
    e = Engine(spark, config.load_config(str(root / "rippleline.toml")))
    e.report = e.sync()
    e.root = root
    return e


def test_counters(engine):
    r = engine.report
    assert (r.services, r.defs, r.unresolved, r.invokes_dropped, r.dynamic_tables, r.dynamic_keys) == (5, 2, 1, 1, 0, 0)
    assert r.edges == engine.store.edges.count() == 14
    names = [(n.id, n.name, n.schema, n.kind) for n in engine.store.nodes.orderBy("id").collect()]
    assert names[:5] == [(0, "PLACE_ORDER", None, "Procedure"), (1, "CHECK_LIMIT", None, "Procedure"), (2, "risk", None, "Service"), (3, "gate", None, "Service"), (4, "bridge", None, "Service")]
    assert ("TLIMIT", "CORE", "Table") in [n[1:] for n in names] and [n[0] for n in names] == list(range(len(names)))


def test_edges(engine):
    n = {r.id: r.name for r in engine.store.nodes.collect()}
    got = {(r.kind, n[r.src], n[r.dst], r.line, tuple(n[p] for p in r.provenance)) for r in engine.store.edges.collect()}
    assert got == {
        ("Owns", "core", "PLACE_ORDER", 1, ()), ("Owns", "core", "CHECK_LIMIT", 6, ()), ("Calls", "PLACE_ORDER", "CHECK_LIMIT", 4, ()), ("Touches", "PLACE_ORDER", "TORDER", 3, ()),
        ("Touches", "CHECK_LIMIT", "TLIMIT", 0, ()), ("Consumes", "risk", "orders", 3, ()), ("Publishes", "risk", "alerts", 4, ("TORDER",)), ("Invokes", "risk", "PLACE_ORDER", 5, ()),
        ("WritesKey", "risk", "risk:limit", 7, ()), ("Publishes", "gate", "orders", 2, ()), ("ReadsKey", "gate", "risk:limit", 3, ()), ("Consumes", "bridge", "alerts", 1, ()),
        ("Publishes", "bridge", "settled", 2, ()), ("Consumes", "settle", "settled", 0, ()),
    }


def test_queries(engine):
    at = lambda df: [(r.name, r.depth) for r in df.collect()]
    assert at(engine.impact("torder")) == [("PLACE_ORDER", 1), ("risk", 2), ("alerts", 3), ("bridge", 4), ("settled", 5)]
    assert at(engine.impact("tlimit")) == [("CHECK_LIMIT", 1), ("PLACE_ORDER", 2), ("risk", 3)]  # the guard knows alerts as other data
    assert at(engine.callers("CHECK_LIMIT", include_weak=True)) == [("core", 1), ("PLACE_ORDER", 1)]
    assert at(engine.callers("CHECK_LIMIT")) == [("PLACE_ORDER", 1)]
    assert set(at(engine.deps("risk", 2))) == {("orders", 1), ("alerts", 1), ("risk:limit", 1), ("PLACE_ORDER", 1), ("CHECK_LIMIT", 2), ("TORDER", 2)}
    producers, consumers = engine.topic("ORDERS")
    assert producers == f"gate ({engine.root}/gate/a.rs:2)" and consumers == f"risk ({engine.root}/risk/a.go:3)"
    assert engine.bridges() == "3 producer→consumer; 1 guarded, 2 COARSE (impact may over-report consumers — declare [svc.provenance] in topics.toml): [orders, settled]"
    with pytest.raises(NotFound, match="closest: PLACE_ORDER"):
        engine.find("PLACE_ORDRE")
    with pytest.raises(NotFound, match="topic not found"):
        engine.topic("risk")


def test_describe_symbol_chunk(engine):
    assert engine.describe().startswith("services=5 procs=2 funcs=0 tables=2 topics=3\ntopic bridges: 3")
    full = engine.describe(full=True)
    assert "sample procs: PLACE_ORDER, CHECK_LIMIT" in full and "unresolved topic sites: 1" in full and "SQL coverage: complete" in full
    assert engine.symbol("tlimit") == "CORE.TLIMIT | Table | schema=CORE | in=1 out=0"
    assert f"def {engine.root}/db/a.sql:1-5" in engine.symbol("place_order", include_path=True)
    assert engine.chunk("place_order") == "CREATE PROCEDURE PLACE_ORDER"
    assert engine.chunk("place_order", False, 2).endswith("CREATE PROCEDURE PLACE_ORDER AS\nBEGIN\n…truncated")
    assert engine.chunk("torder") == "TORDER: no source chunk"


def test_affected(engine):
    d = "diff --git a/db/a.sql b/db/a.sql\n--- a/db/a.sql\n+++ b/db/a.sql\n@@ -7,1 +7,1 @@\n-x\n+y\n"
    report = engine.affected(d)
    assert [(c["name"], c["lines"], c["source"]) for c in report.changed] == [("CHECK_LIMIT", "7-7", "chunk overlap"), ("PLACE_ORDER", "7-7", "edge path")]
    assert report.cross_service == ["risk", "bridge", "settle"] and {"name": "risk", "kind": "Service", "depth": 2} in report.blast_radius
    md = render.affected_md(report)
    assert "## Changed symbols" in md and "## Cross-service impact\n- risk\n- bridge" in md and '"cross_service": ["risk", "bridge", "settle"]' in render.affected_json(report)
    args = argparse.Namespace(config=str(engine.root / "rippleline.toml"), command="affected", fail_on="cross-service", out="md")
    assert cli.run(args, engine.spark, d)[1] == 1
    assert cli.run(args, engine.spark, "nothing\n") == ("no changed hunks in diff", 0)
    with pytest.raises(ValueError):
        engine.affected("")


def test_command_line(engine):
    run = lambda *a: cli.run(cli.parser().parse_args(["--config", str(engine.root / "rippleline.toml"), *a]), engine.spark)
    assert run("impact", "torder")[0].startswith("d1: [PLACE_ORDER:Procedure via:Touches]\nd2: [risk:Service via:Invokes]")
    assert run("callers", "alerts")[0].splitlines()[0].startswith("risk:Service via:Publishes (")
    assert run("impact", "settled", "--depth", "0")[0] == "(none)"
    assert run("deps", "no_such")[0].startswith("not found: no_such") and run("topic", "zzz") == ("topic not found: zzz", 1)


def test_server(engine):
    from rippleline import serve

    def ask(method, params=None, id_=1):
        return serve.answer(engine, {"jsonrpc": "2.0", "id": id_, "method": method, "params": params or {}})

    call = lambda tool, **a: ask("tools/call", {"name": tool, "arguments": a})["result"]["content"][0]["text"]
    assert ask("initialize")["result"]["capabilities"] == {"tools": {}}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["describe_corpus", "get_symbol", "get_callers", "get_dependencies", "get_impact", "get_topic", "get_chunk"]
    assert call("get_impact", name="torder", max_results=2) == "d1: [PLACE_ORDER:Procedure via:Touches]\nd2: [risk:Service via:Invokes]"
    assert call("get_callers", name="check_limit").startswith("PLACE_ORDER:Procedure via:Calls (")
    assert call("get_dependencies", name="settle").startswith("settled:Topic via:Consumes")
    assert call("get_topic", name="orders").startswith("orders\nproducers: gate (")
    assert call("get_topic", name="risk").startswith("topic not found: risk") and call("get_symbol", name="nope").startswith("not found: nope")
    assert call("get_chunk", name="check_limit") == "CREATE PROCEDURE CHECK_LIMIT" and "SQL coverage" in call("describe_corpus")
    assert ask("no/such")["error"]["code"] == -32601 and serve.answer(engine, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    assert ask("tools/call", {"name": "get_impact", "arguments": {}})["error"]["code"] == -32602
    import io

    out = io.StringIO()
    serve.serve(engine, io.StringIO('{"jsonrpc":"2.0","id":7,"method":"ping"}\n\nnot json\n'), out)
    assert [__import__("json").loads(x) for x in out.getvalue().splitlines()] == [{"jsonrpc": "2.0", "id": 7, "result": {}}, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}]


def test_store_versions(engine, spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    for _ in range(3):
        store.save(engine.store, path)
    assert len(store.versions(spark, path)) == 3
    store.prune(spark, path, keep=1)
    again = store.load(spark, path)
    assert again.nodes.count() == engine.store.nodes.count()
    assert sorted(map(str, again.edges.collect())) == sorted(map(str, engine.store.edges.collect()))
    meta = again.meta.withColumn("version", again.meta.version + 1)
    import shutil

    at = f"{path}/{store.versions(spark, path)[-1]}/meta"
    rows = meta.collect()
    shutil.rmtree(at)
    spark.createDataFrame(rows, meta.schema).write.parquet(at)
    with pytest.raises(ValueError, match="store version"):
        store.load(spark, path)


def test_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    (src / "a.rs").write_text('FutureRecord::to("one");\n')
    run = lambda: ingest.start(ingest.stream_files(spark, str(src), "svc"), out, str(tmp_path / "ck")).awaitTermination()
    run()
    (src / "b.rs").write_text('c.subscribe(&["two"]);\n')
    (src / "skip.txt").write_text('FutureRecord::to("no");\n')
    run()
    now = lambda: {(r.kind, r.dst) for r in ingest.current_edges(spark, out).collect()}
    up = lambda: ingest.catch_up(spark, str(src), "svc", out, 1)
    assert now() == {("Publishes", "one"), ("Consumes", "two")} and up() == (0, 0)
    (src / "a.rs").write_text("fn nothing() {}\n")  # a new version without edges
    (src / "b.rs").write_text('c.subscribe(&["three"]);\n')
    (src / "c d+e%.rs").write_text('FutureRecord::to("four");\n')
    was = os.stat(src / "c d+e%.rs").st_mtime
    os.utime(src / "a.rs", (was + 50, was + 50))
    os.utime(src / "b.rs", (was - 50, was - 50))  # older than what it replaces
    run()
    assert ("Publishes", "four") in now()
    assert up() == (2, 0) and now() == {("Consumes", "three"), ("Publishes", "four")}
    (src / "a.rs").write_text("")
    (src / "b.rs").unlink()
    (src / "vendor").mkdir()
    (src / "vendor/d.rs").write_text('FutureRecord::to("no");\n')
    assert up() == (0, 2) and now() == {("Publishes", "four")} and up() == (0, 0)
    assert ingest.catch_up(spark, str(src), "svc", str(tmp_path / "other")) == (1, 0)


def test_stream_and_catch_up_agree_on_files_that_are_not_text(spark, tmp_path):
    src, line = tmp_path / "src", 'var a = &kgo.Record{Topic: "x%s", Value: v}\n'
    src.mkdir()
    (src / "bad.go").write_bytes((line % "1").encode() + b'var b = &kgo.Record{Topic: "y\xff", Value: v}\n')
    (src / "good.go").write_text(line % "2")
    outs = [str(tmp_path / o) for o in ("streamed", "caught")]
    ingest.start(ingest.stream_files(spark, str(src), "svc"), outs[0], str(tmp_path / "ck")).awaitTermination()
    ingest.catch_up(spark, str(src), "svc", outs[1])
    for out in outs:
        assert [(e.kind, e.dst) for e in ingest.current_edges(spark, out).collect()] == [("Publishes", "x2")]
        assert ingest.current_files(spark, out).count() == 2


def test_table_function_fills_batches(spark):
    """Many rows that give few each make few batches, and rows that give many are cut."""
    rows = spark.range(3000, numPartitions=2)
    made = table_function(rows, ["id"], lambda i: [(i, str(j)) for j in range(3 if i else 30_000)], "id long, j string")
    assert made.count() == 30_000 + 3 * 2999 and made.where("id = 7").count() == 3
    assert table_function(rows.limit(0), ["id"], lambda i: [(i,)], "id long").count() == 0
