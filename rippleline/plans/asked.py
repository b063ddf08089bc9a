"""Registered queries that go the whole way: a tree through the sync into a store on disk, and questions to the engine that reads it; a tree of
files on disk, and its scan; and what the tree of `extraction` has no case of.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline import serve
from rippleline.api import Engine
from rippleline.operators import cache_keys, messages
from rippleline.operators.lookup import first_coverage
from rippleline.plans.catalogue import register
from rippleline.plans.extraction import _NAT, _SUP, _TREE, built, diff_text, suppliers
from rippleline.runtime import table_path
from rippleline.sources.config import Config
from rippleline.sources.files import scan_tree
from rippleline.sources.shared import write_files
from rippleline.sources.store import save
from rippleline.sources.tree import pruned_tree

_ENGINES: dict[tuple[str, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over the saved store of the whole tree, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        path = table_path(spark, "store")
        save(built(spark, sf_dir)[0], path)
        _ENGINES[key] = Engine(spark, Config(store=path), hold=0)
    return _ENGINES[key]


def _reach(start: str, depth: int, steps: str) -> str:
    return f"""WITH RECURSIVE {_TREE}, steps AS ({steps}), r(node, depth) AS (SELECT '{start}', 0 UNION SELECT nxt, depth + 1 FROM r JOIN steps ON cur = node WHERE depth < {depth})
SELECT node AS key, min(depth)::INTEGER AS depth FROM r WHERE node <> '{start}' GROUP BY node"""


@register("engine_callers", _reach("GEO.NATION_3", 2, "SELECT dst AS cur, src AS nxt FROM e WHERE kind <> 'Owns'"))
def engine_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).callers("geo.nation_3", 2, cap=None).select("key", "depth")


@register("engine_dependencies", _reach("S1", 3, "SELECT src AS cur, dst AS nxt FROM e WHERE kind <> 'Owns'"))
def engine_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).deps("s1", 3).select("key", "depth")


@register("engine_impact", _reach("GEO.NATION_3", 2, """SELECT CASE WHEN kind = 'Publishes' THEN src ELSE dst END AS cur, CASE WHEN kind = 'Publishes' THEN dst ELSE src END AS nxt FROM e
  WHERE kind <> 'Owns' AND NOT (kind = 'Publishes' AND src = 'S1' AND dst = 'parts-1' AND (SELECT r FROM n WHERE k = 3) <> 0)"""))
def engine_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the guard: what S1 publishes to parts-1 is known to be data of region 0."""
    return engine(spark, sf_dir).impact("geo.nation_3", 2, cap=None).select("key", "depth")


@register("engine_topic", f"""WITH {_SUP} SELECT (SELECT string_agg(svc || ' (' || path || ':3)', '; ' ORDER BY k) FROM s WHERE k % 10 = 3) AS producers,
  (SELECT string_agg(svc || ' (' || path || ':' || [4, 2, 2][l + 1] || ')', '; ' ORDER BY k) FROM s WHERE k % 10 = 2) AS consumers""")
def engine_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([engine(spark, sf_dir).topic("PARTS-3")], "producers string, consumers string")


@register("engine_symbol", f"""WITH {_TREE} SELECT 'GEO.NATION_3 | Procedure | schema=GEO | def /core/nation_3.sql:4-8 | in=' || count_if(dst = 'GEO.NATION_3') || ' out=' || count_if(src = 'GEO.NATION_3') AS text FROM e
UNION ALL SELECT 'parts-3 | Topic | schema=- | in=' || count_if(dst = 'parts-3') || ' out=0' FROM e""")
def engine_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return spark.createDataFrame([(e.symbol("geo.nation_3", include_path=True),), (e.symbol("parts-3", include_path=True),)], "text string")


@register("engine_chunk", f"""WITH {_NAT} SELECT '-- ' || path || E':4-8\\nCREATE OR REPLACE PROCEDURE geo.NATION_' || k || E'(p IN NUMBER) AS\\nBEGIN\\n…truncated' AS text FROM n WHERE k = 3
UNION ALL SELECT 'create function RATE_' || k || '(p number)' FROM n WHERE k = 3 UNION ALL SELECT 'REGION_0: no source chunk'""")
def engine_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return spark.createDataFrame([(e.chunk("geo.nation_3", False, 2),), (e.chunk("rate_3"),), (e.chunk("region_0"),)], "text string")


@register("engine_describe", f"""WITH {_TREE} SELECT 'services=' || (SELECT count(*) + 1 FROM s) || ' procs=' || (SELECT count(*) FROM n) || ' funcs=' || (SELECT count(*) FROM n)
  || ' tables=' || count(DISTINCT dst) FILTER (kind = 'Touches') || ' topics=' || count(DISTINCT dst) FILTER (kind IN ('Publishes', 'Consumes')) AS text FROM e""")
def engine_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of the description."""
    return spark.createDataFrame([(engine(spark, sf_dir).describe().split("\n")[0],)], "text string")


@register("engine_affected", f"""WITH {_NAT} SELECT CASE WHEN k % 2 = 1 THEN proc ELSE func END AS name, CASE WHEN k % 2 = 1 THEN 'Procedure' ELSE 'Function' END AS kind, CASE WHEN k % 2 = 1 THEN '6-6' ELSE '9-9' END AS lines, 'chunk overlap' AS source, true AS crosses FROM n
UNION ALL SELECT proc, 'Procedure', '9-9', 'edge path', true FROM n WHERE k % 2 = 0
UNION ALL SELECT 'S' || s_suppkey, 'Service', '2-3', 'edge path', true FROM supplier WHERE s_suppkey = 1""")
def engine_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a diff changed, and whether the report lists services that didn't change; its text and its report are the driver's."""
    report = engine(spark, sf_dir).affected(diff_text(spark, sf_dir))
    rows = [(c["name"], c["kind"], c["lines"], c["source"], bool(report.cross_service)) for c in report.changed]
    return spark.createDataFrame(rows, "name string, kind string, lines string, source string, crosses boolean")


_KIND = "CASE kind WHEN 'Touches' THEN 'Table' WHEN 'Invokes' THEN CASE WHEN dst LIKE 'RATE%' THEN 'Function' ELSE 'Procedure' END WHEN 'WritesKey' THEN 'RedisKey' WHEN 'ReadsKey' THEN 'RedisKey' ELSE 'Topic' END"


@register("engine_tools", f"""WITH {_TREE} SELECT 'get_callers' AS tool, src || CASE WHEN kind = 'Calls' THEN ':Procedure' ELSE ':Service' END || ' via:' || kind || ' (' || path || ':' || line || ')' AS line FROM e WHERE dst = 'GEO.NATION_3' AND kind <> 'Owns'
UNION ALL SELECT 'get_dependencies', dst || ':' || {_KIND} || ' via:' || kind || ' (' || path || ':' || line || ')' FROM e WHERE src = 'S1'
UNION ALL SELECT 'get_impact', 'd1: [GEO.NATION_3:Procedure via:Calls]'
UNION ALL SELECT 'get_topic', unnest(['parts-3', 'producers: ' || (SELECT string_agg(svc || ' (' || path || ':3)', '; ' ORDER BY k) FROM s WHERE k % 10 = 3), 'consumers: ' || (SELECT string_agg(svc || ' (' || path || ':' || [4, 2, 2][l + 1] || ')', '; ' ORDER BY k) FROM s WHERE k % 10 = 2)])
UNION ALL SELECT 'get_chunk', 'CREATE OR REPLACE PROCEDURE geo.NATION_3(p IN NUMBER)'""")
def engine_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the tool server, line by line. Callers are asked for as many as the symbol has edges to it."""
    e = engine(spark, sf_dir)
    most = int(re.search(r" in=(\d+) ", e.symbol("geo.nation_3"))[1])
    asked = (
        ("get_callers", {"name": "geo.nation_3", "max_results": most}), ("get_dependencies", {"name": "s1"}), ("get_impact", {"name": "rate_3", "depth": 1, "max_results": 1}),
        ("get_topic", {"name": "parts-3"}), ("get_chunk", {"name": "nation_3"}),
    )
    rows = []
    for i, (tool, arguments) in enumerate(asked):
        reply = serve.answer(e, {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
        rows += [(tool, line) for line in reply["result"]["content"][0]["text"].split("\n")]
    return spark.createDataFrame(rows, "tool string, line string")


# What the tree of `extraction` has no case of: other shapes of calls, and a wrapper that a service defines twice; {..} are filled per supplier.
_SHAPES = {
    "go": 'const T = "shape-{t}"\nkgo.ConsumeTopics(T, "a-{u}")\np.ConsumePartition(T, 0, 1)\ng.Consume(ctx, []string{"b-{u}"}, h)\nc.Consume(ctx, T)\nkgo.DefaultProduceTopic("d-{u}")\nm := sarama.ProducerMessage{Topic: "e-{u}", V: v}\n',
    "rust": 'const T: &str = "shape-{t}";\nBaseRecord::to(T).payload(p);\n',
    "cpp": 'constexpr auto T = "shape-{t}";\nTopicPartition::create(T, 0);\nRdKafka::Topic::create(p, "f-{u}", c, e);\n',
}
_WRITER = "func (s *Store) Put(ctx context.Context, key string) { s.rdb.HSet(ctx, key, 1) }\n"
_READER = "func (s *Store) Put(key string) { s.rdb.Get(ctx, key) }\n"


def _filled(text, **values):
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


@register("x_call_shapes", f"""WITH {_SUP}, a AS (SELECT *, 'shape-' || (k % 10) AS t, ((k + 1) % 10)::VARCHAR AS u FROM s), c AS (
  SELECT svc, path, unnest([('Consumes', t, 2), ('Consumes', 'a-' || u, 2), ('Consumes', t, 3), ('Consumes', 'b-' || u, 4), ('Consumes', t, 5), ('Publishes', 'd-' || u, 6), ('Publishes', 'e-' || u, 7)]) AS x FROM a WHERE l = 0
  UNION ALL SELECT svc, path, ('Publishes', t, 2) FROM a WHERE l = 1 UNION ALL SELECT svc, path, unnest([('Consumes', t, 2), ('Publishes', 'f-' || u, 3)]) FROM a WHERE l = 2
) SELECT x[1] AS kind, svc AS src, x[2] AS dst, path, x[3] AS line FROM c""")
def x_call_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shape of a publishing and a consuming call that `x_topics` has none of."""
    k = F.col("s_suppkey")
    lang = F.element_at(F.array(*[F.lit(x) for x in _SHAPES]), (k % 3).cast("int") + 1)
    text = _filled(F.element_at(F.array(*[F.lit(x) for x in _SHAPES.values()]), (k % 3).cast("int") + 1), t=k % 10, u=(k + 1) % 10)
    path = F.concat(F.format_string("/s%d/main.", k), F.when(lang == "rust", "rs").otherwise(lang))
    files = suppliers(spark, sf_dir).select(F.format_string("S%d", k).alias("service"), (k + 1).cast("int").alias("source_ord"), path.alias("path"), lang.alias("lang"), text.alias("content"))
    return messages.topic_edges(messages.topic_sites(files)).select("kind", "src", "dst", "path", "line")


@register("x_wrapper_first", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'WritesKey' ELSE 'ReadsKey' END AS kind, 'S' || s_suppkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN 'pair:' ELSE 'lone:' END || (s_suppkey % 4) AS dst, '/s' || s_suppkey || '/c.go' AS path, 1 AS line FROM supplier""")
def x_wrapper_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that define a wrapper twice, in files a and b: the first holds, with what it does and where its key stands."""
    k = F.col("s_suppkey")
    a, b = F.when(k % 2 == 0, _WRITER).otherwise(_READER), F.when(k % 2 == 0, _READER).otherwise(_WRITER)
    each = F.explode(F.create_map(F.lit("b"), b, F.lit("a"), a, F.lit("c"), _filled(F.lit('store.Put("lone:{f}", "pair:{f}")\n'), f=k % 4))).alias("file", "content")
    files = suppliers(spark, sf_dir).select("s_suppkey", each).select(F.format_string("S%d", k).alias("service"), (k + 1).cast("int").alias("source_ord"), F.format_string("/s%d/%s.go", k, "file").alias("path"), F.lit("go").alias("lang"), "content")
    return cache_keys.key_edges(cache_keys.accesses(cache_keys.calls(files), cache_keys.wrappers(files))).select("kind", "src", "dst", "path", "line")


#: A file of each supplier by its key modulo eight: (folder and name, language, or none where the scan leaves it).
DISK = (("main.go", "go"), ("vendor/x.go", None), ("deep/lib.hpp", "cpp"), ("bad.rs", "rust"), ("lib.HPP", None), ("build/gen/y.rs", None), ("a.b/z w+%.cc", "cpp"), ("vendored/t.h", "cpp"))


_DISK_SQL = "WITH f AS (SELECT s_suppkey AS k, [{}][s_suppkey % 8 + 1] AS f FROM supplier) SELECT 's' || k || '/' || f[1] AS path, f[2] AS lang, CASE WHEN k % 8 <> 3 THEN 'supplier ' || k || ' é' END AS content FROM f WHERE f[2] IS NOT NULL".format(
    ", ".join(f"('{name}', {repr(lang) if lang else 'NULL'})" for name, lang in DISK))


def _on_disk(spark: SparkSession, sf_dir: str, scan: Callable[..., DataFrame]) -> DataFrame:
    """A tree written to disk of the suppliers, and its scan: skipped folders, languages by extension, and files that aren't UTF-8."""
    k, root = F.col("s_suppkey"), table_path(spark, "tree")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in DISK]), (k % 8).cast("int") + 1)
    content = F.concat(F.encode(F.format_string("supplier %d é", k), "UTF-8"), F.when(k % 8 == 3, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    write_files(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.format_string("s%d/", k), name).alias("path"), content.alias("content")), root)
    return scan(spark, root, "disk").select(F.substring_index("path", root.rpartition("/")[2] + "/", -1).alias("path"), "lang", "content")


@register("disk_scan", _DISK_SQL)
def disk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _on_disk(spark, sf_dir, scan_tree)


@register("disk_pruned", _DISK_SQL)
def disk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the data source that prunes the descent."""
    return _on_disk(spark, sf_dir, pruned_tree)


# A service of SQL sources: the first source that names it says whether it has a dump.
@register("coverage_first", """SELECT 'S' || s_nationkey AS service, arg_min(s_suppkey % 3 = 0, s_suppkey) AS has_dump FROM supplier GROUP BY s_nationkey""")
def coverage_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("source_ord"), F.format_string("S%d", "s_nationkey").alias("service"), (k % 3 == 0).alias("has_dump"))
    return first_coverage(found)
