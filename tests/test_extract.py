"""Extractors, lexers, diff, sources."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rippleline.functions import text as tx
from rippleline.operators import cache_keys, diff, embedded_sql, lexer, lookup, messages, plsql
from rippleline.schema import FILES
from rippleline.sources import config, dictionary, files as file_source
from pyspark.sql import functions as F

SQL = """CREATE OR REPLACE PROCEDURE APP."PLACE_ORDER"(p IN NUMBER) AS
BEGIN
  /* CREATE PROCEDURE HIDDEN
     two lines */
  BEGIN check_limit(p); END;
  EXECUTE IMMEDIATE 'INSERT INTO app.torder SELECT * FROM dual JOIN tclient';
END;
-- create function gone return number
create function total_of(p number) return number is
begin if (1) then return 1; end if; end;
CREATE PROCEDURE check_limit AS BEGIN NULL; END;
"""


def files(spark, *rows):
    return spark.createDataFrame([("svc", 0, p, lang, text) for p, lang, text in rows], FILES)


def test_definitions_and_dynamic_sql(spark):
    defs = plsql.definitions(files(spark, ("/s/a.sql", "sql", SQL)))
    got = {r.title: (r.schema, r.kind, r.line_start, r.line_end) for r in defs.collect()}
    assert got == {"PLACE_ORDER": ("APP", "Procedure", 1, 8), "TOTAL_OF": (None, "Function", 9, 10), "CHECK_LIMIT": (None, "Procedure", 11, 11)}
    signature = {r.title: r.signature for r in defs.collect()}
    assert signature["PLACE_ORDER"] == 'CREATE OR REPLACE PROCEDURE APP."PLACE_ORDER"(p IN NUMBER)'
    assert signature["TOTAL_OF"] == "create function total_of(p number)"
    edges = {(r.kind, r.src, r.dst, r.line) for r in plsql.dynamic_edges(defs).collect()}
    assert edges == {("Calls", "APP.PLACE_ORDER", "CHECK_LIMIT", 5), ("Touches", "APP.PLACE_ORDER", "TORDER", 6), ("Touches", "APP.PLACE_ORDER", "TCLIENT", 6)}
    assert {(r.src, r.dst, r.line) for r in plsql.owns(defs).collect()} == {("svc", "APP.PLACE_ORDER", 1), ("svc", "TOTAL_OF", 9), ("svc", "CHECK_LIMIT", 11)}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="-/* \nabC'", max_size=60))
def test_blanking_keeps_lines(text):
    assert plsql.blank_comments(text).count("\n") == text.count("\n")


GO = '''package x
const TopicA = "orders.new"
var (
\ttopicB = "fills.v1"
)
func f() {
\tcl.AddConsumeTopics(TopicA, "raw-topic", pkg.Other)
\tr := &kgo.Record{Topic: topicB, Value: v}
\tdb.Exec("PLACE_ORDER", CHECK_LIMIT)
\tplain("NOT_A_CALL_SITE")
}
'''


def test_topics_and_invokes(spark):
    fs = files(
        spark, ("/c/a.go", "go", GO), ("/c/b.rs", "rust", 'const T: &str = "alerts";\nc.subscribe(&[T, "fills"])\nFutureRecord::to(&T)\n'),
        ("/c/c.cpp", "cpp", 'constexpr auto kT = "trades";\nconsumer.subscribe({kT, "x.y"});\np.produce("out", 1); Topic::create(p, kT, c);\n'),
    )
    sites = messages.topic_sites(fs)
    got = [(r.kind, r.dst, r.path[-1], r.line) for r in messages.topic_edges(sites).orderBy("seq").collect()]
    assert got == [
        ("Consumes", "orders.new", "o", 7), ("Consumes", "raw-topic", "o", 7), ("Publishes", "fills.v1", "o", 8),
        ("Consumes", "alerts", "s", 2), ("Consumes", "fills", "s", 2), ("Publishes", "alerts", "s", 3),
        ("Consumes", "trades", "p", 2), ("Consumes", "x.y", "p", 2), ("Publishes", "trades", "p", 3), ("Publishes", "out", "p", 3),
    ]
    assert [(r.loc, r.line) for r in messages.unresolved(sites).collect()] == [("svc:/c/a.go", 7)]
    assert [(r.dst, r.line) for r in messages.invokes(fs).where("path like '%.go'").orderBy("seq").collect()] == [("PLACE_ORDER", 9), ("CHECK_LIMIT", 9)]


def test_literals_of_three_languages():
    assert lexer.literals("go", 'a("x\\ty", `raw\n"q"`) // "no"\n\'"\'') == [("x y", 1), ('raw\n"q"', 1)]
    assert lexer.literals("rust", 'f("a", r#"b "q" c"#, \'"\'); /* "no" */ let x: &\'static str = b"z";') == [("a", 1), ('b "q" c', 1), ("z", 1)]
    assert lexer.literals("cpp", 'f("SELECT a "\n  "FROM t", R"x(raw ")" y)x", \'"\');') == [("SELECT a  FROM t", 1), ('raw ")" y', 2)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["go", "rust", "cpp"]), st.text(alphabet="\"'`\\/*\n(){}[],.:=rR#abfunc cmd<>!ctx", max_size=80))
def test_lexers_take_anything(lang, text):
    lexer.literals(lang, text)
    cache_keys.scan_calls(lang, text)
    if lang == "go":
        cache_keys.go_wrappers(lexer.tokens("go", text))


def test_embedded_sql(spark):
    go = 'db.Query(`\n select a from app.orders o join "Lines" l where x=1`)\nlog("Insert group service problems.")\nq("BEGIN do_it(1); END;")\nq("update %s set x=1 from t2")\n'
    sql = embedded_sql.sql_literals(embedded_sql.string_literals(files(spark, ("/c/a.go", "go", go))))
    got = [(r.kind, r.dst, r.line, r.from_kind) for r in embedded_sql.sql_edges(sql).orderBy("seq").collect()]
    assert got == [("Touches", "ORDERS", 1, "Service"), ("Touches", "LINES", 1, "Service"), ("Invokes", "DO_IT", 4, None)]
    assert embedded_sql.dynamic_count(sql).first().dynamic_tables == 0  # "update %s" doesn't look like SQL
    dyn = embedded_sql.sql_literals(embedded_sql.string_literals(files(spark, ("/c/a.go", "go", 'q("select 1 from %s join $1")'))))
    assert embedded_sql.dynamic_count(dyn).first().dynamic_tables == 2


REDIS = '''package r
func (s *Store) Put(ctx context.Context, key, field string, v int) error { return s.rdb.HSet(ctx, key, field, v).Err() }
func Load(ctx context.Context, key string) { rdb.Get(ctx, "fixed") }
func use(ctx context.Context, id string) {
	k := "sess:" + id
	rdb.Get(ctx, k)
	rdb.Set(ctx, fmt.Sprintf("order:%s:%d", id, 1), v, 0)
	rdb.Del(ctx, id)
	cache.Get(id)
	store.Put(ctx, "cfg:main", "f", 1)
	store.Put(ctx, dyn(), "f", 1)
	rdb.Incr(ctx, fmt.Sprintf("%s:%d", a, b))
}
'''


def test_cache_keys(spark):
    rust = 'redis::cmd("GET").arg("k1").arg("not").query(&mut c);\ncon.set_ex::<_, ()>(1);\ncon.hgetall::<_, M>(format!("user:{}", id));\ncmd("SET").arg(v);\n'
    cpp = 'redisCommand(c, "SET order:%s %d", a, b);\nredisCommand(c, "GET %s", k);\nother(c, "GET x");\n'
    fs = files(spark, ("/c/a.go", "go", REDIS), ("/c/b.rs", "rust", rust), ("/c/c.cc", "cpp", cpp))
    known = cache_keys.wrappers(fs)
    assert [tuple(r) for r in known.collect()] == [("svc", "Put", "WritesKey", 1)]
    found = cache_keys.accesses(cache_keys.calls(fs), known)
    got = {(r.path[-1], r.kind, r.key, r.line) for r in found.collect()}
    assert got == {
        ("o", "WritesKey", None, 2), ("o", "ReadsKey", "fixed", 3), ("o", "ReadsKey", "sess:*", 6), ("o", "WritesKey", "order:*:*", 7), ("o", "WritesKey", None, 8),
        ("o", "WritesKey", "cfg:main", 10), ("o", "WritesKey", None, 11), ("o", "WritesKey", None, 12),
        ("s", "ReadsKey", "k1", 1), ("s", "ReadsKey", "user:*", 3), ("s", "WritesKey", None, 4), ("c", "WritesKey", "order:*", 1), ("c", "ReadsKey", None, 2),
    }
    assert cache_keys.key_edges(found).count() == 7


def test_text_functions(spark):
    df = spark.createDataFrame([("sess:%s:%02d",), ("%s:%d",), ("plain",)], "k string")
    assert [r[0] for r in df.select(tx.key_pattern(F.col("k"))).collect()] == ["sess:*:*", None, "plain"]
    one = spark.range(1).select(tx.age(F.lit(59)), tx.age(F.lit(3600)), tx.age(F.lit(90000)), tx.ascii_upper(F.lit("aß")), tx.common_prefix(F.lit("ABCDEFGH"), F.lit("ABCDEFGX")), tx.looks_like_sql(F.lit(" With x")), tx.looks_like_sql(F.lit("Insert groups")))
    assert tuple(one.first()) == ("59s ago", "1h ago", "1d ago", "Aß", 6, True, False)
    parts = spark.createDataFrame([(["a", "", None, "b"],)], "x array<string>").select(tx.lines(F.lit("a\r\nb\n")), tx.lines(F.lit("")), tx.lines(F.lit("x"))).first()
    assert tuple(map(tuple, parts)) == (("a", "b"), (), ("x",))


DIFF = """diff --git a/src/a.go b/src/a.go
--- a/src/a.go
+++ b/src/a.go
@@ -1,2 +3,4 @@ func
 x
+++ looks like a header
+y
+z
-w
@@ -9 +12 @@
-a
+b
diff --git a/old b/old
--- a/old
+++ /dev/null
@@ -1,1 +0,0 @@
-gone
"""


def test_hunks(spark):
    assert [tuple(r)[1:] for r in diff.hunks(spark, DIFF).orderBy("pos").collect()] == [("src/a.go", 3, 6), ("src/a.go", 12, 12)]
    assert diff.hunks(spark, "").isEmpty()


def test_lookup(spark):
    nodes = spark.createDataFrame([(0, "PLACE_ORDER", "APP", "Procedure"), (1, "PLACE_FILL", None, "Procedure"), (2, "place_order", None, "Topic")], "id long, name string, schema string, kind string")
    assert lookup.find(nodes, "app.place_order").first().id == 0
    assert lookup.find(nodes, "Place_Order").first().id == 2  # a full key comes before a bare name
    assert lookup.find(nodes, "none").isEmpty()
    row, message = lookup.find_or_suggest(nodes, "PLACE_ORDR")
    assert row is None and message.startswith("not found: PLACE_ORDR — closest: ") and "PLACE_FILL" in message
    assert lookup.find_or_suggest(nodes, "§")[1] == "not found: §"


def test_dictionary(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('name,type,ref_name,ref_type\n"place_order",PROCEDURE,torder,table\n\nx,y\nA,PROCEDURE,B,PACKAGE\nA,PROCEDURE,S,SEQUENCE\n')
    rows = dictionary.read_dump(spark, str(path))
    got = [(r.kind, r.src, r.dst) for r in dictionary.dump_edges(rows, "oms-core").orderBy("seq").collect()]
    assert got == [("Touches", "OMS-CORE.PLACE_ORDER", "OMS-CORE.TORDER"), ("Calls", "OMS-CORE.A", "OMS-CORE.B")]
    (tmp_path / "bad.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="expected a header"):
        dictionary.read_dump(spark, str(tmp_path / "bad.csv"))
    sql = dictionary.dictionary_query("o'x")
    assert "UPPER('o''x')" in sql and " UNION " in sql and "all_dependencies" in sql
    deps = spark.createDataFrame([("P", "PROCEDURE", "T", "TABLE", "S", "S"), ("P", "TRIGGER", "T", "TABLE", "S", "S")], "name string, type string, referenced_name string, referenced_type string, owner string, referenced_owner string")
    source = spark.createDataFrame([("P", "PROCEDURE", "x Begin  call_me (1)", "S"), ("P", "PROCEDURE", "begin if (1)", "S"), ("P", "PROCEDURE", "BEGIN call_me(2)", "S")], "name string, type string, text string, owner string")
    assert {tuple(r) for r in dictionary.dictionary_rows(deps, source, "s").collect()} == {("P", "PROCEDURE", "T", "TABLE"), ("P", "PROCEDURE", "CALL_ME", "PROCEDURE")}
    assert dictionary.dump_path("/a/b/store", "oms core") == "/a/b/oms_core-dependencies.csv"


def test_config_and_registry(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "rippleline.toml").write_text('[store]\npath = "out/store"\n[[sources]]\nkind = "sql"\npath = "db"\nservice = "core"\n[[sources]]\nkind="code"\npath="/abs"\nservice="gw"\n')
    c = config.discover(str(tmp_path / "sub"))
    assert c.store == str(tmp_path / "out/store") and [s.path for s in c.sources] == [str(tmp_path / "db"), "/abs"] and c.registry == str(tmp_path / "topics.toml")
    got = config.parse_registry('x = 1\n[b]\nconsumes = ["t", 3]\n[a]\npublishes = ["p"]\n[a.provenance]\np = ["T1", "T2"]\n')
    assert got == [("a", ["p"], [], {"p": ["T1", "T2"]}), ("b", [], ["t"], {})]
    with pytest.raises(FileNotFoundError):
        config.discover("/")


def test_tree(spark, tmp_path):
    for name, data in (("a.go", b"x"), ("vendor/b.go", b"x"), ("s/target/c.rs", b"x"), ("s/d.hpp", b"y"), ("e.txt", b"x"), ("bad.go", b"\xff\xfe")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {(r.path.removeprefix(str(tmp_path)), r.lang) for r in file_source.read_tree(spark, str(tmp_path), "s").collect()}
    assert got == {("/a.go", "go"), ("/s/d.hpp", "cpp")}
    with pytest.raises(Exception, match="not UTF-8"):
        file_source.read_tree(spark, str(tmp_path), "s", strict=True).collect()
