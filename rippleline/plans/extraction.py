"""Registered queries of the extraction side: a source tree written from the driver's tables, read back by the extractors.

Each nation is a PL/SQL file of service `core`, each supplier a Go, Rust or C++ file of a service of its own; so what extractors must
find is known from the tables, and SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.operators import cache_keys, diff, embedded_sql, graph, lookup, messages, plsql
from rippleline.plans.catalogue import register
from rippleline.schema import FILES, REGISTRY, SQL_KINDS
from rippleline.sources import dictionary
from rippleline.sources.store import Store
from rippleline.sync import build


def sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    text = F.format_string(
        "-- nation %d\n/* create procedure FAKE_%d as\n */\nCREATE OR REPLACE PROCEDURE geo.NATION_%d(p IN NUMBER) AS\nBEGIN\n  EXECUTE IMMEDIATE 'UPDATE geo.REGION_%d SET x = 1';\n  BEGIN NATION_%d(p); END;\nEND;\ncreate function RATE_%d(p number) return number is begin null; end;\n",
        k, k, k, r, (k + 1) % 25, k,
    )
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("core").alias("service"), F.lit(0).alias("source_ord"), F.format_string("/core/nation_%d.sql", k).alias("path"), F.lit("sql").alias("lang"), text.alias("content"))


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of a dictionary dump for each nation, one that no edge follows from, and one that is too short."""
    k = F.col("n_nationkey")
    made = F.array(F.format_string('rate_%d,FUNCTION,"trates_%d",TABLE', k, k % 3), F.format_string('"nation_%d",PROCEDURE,rate_%d,FUNCTION', k, k), F.lit("rate_0,FUNCTION,seq,SEQUENCE"), F.lit("short,row"))
    each = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.posexplode(made).alias("i", "line"))
    return each.select((F.col("n_nationkey") * 4 + F.col("i") + 1).cast("long").alias("pos"), "line")


# Each language publishes, consumes, invokes, touches and keeps keys in ways of its own; {..} are filled per supplier.
_GO = """const Topic = "parts-{t}"
const PROC = "NATION_{n}"
r := kgo.Record{Topic: Topic, Value: v}
c.AddConsumeTopics("parts-{u}", unknown)
db.Exec(PROC, "NO_SUCH_PROC")
rdb.Set(ctx, fmt.Sprintf("sup:%d:{m}", id), 1)
db.Query("select a from geo.region_{r} where 1 = 1")
func (s *Store) Put(ctx context.Context, key string) { s.rdb.HSet(ctx, key, 1) }
store.Put(ctx, "cfg:{f}")
rdb.Get(ctx, id)
db.Query("select 1 from %s join $1")
q("BEGIN RATE_{n}(1); END;")
"""
_RUST = """const T: &str = "parts-{t}";
c.subscribe(&[unknown, "parts-{u}"]);
FutureRecord::to(T);
conn.execute("NATION_{n}", "NO_SUCH_PROC");
redis::cmd("SET").arg(format!("sup:{}:{m}", id));
con.hgetall::<_, M>("cfg:{f}");
con.get::<_, String>(id);
let q = "select a from geo.region_{r} where 1 = 1";
let d = "delete from :tab";
call("CALL RATE_{n}(1)");
"""
_CPP = """static const std::string T = "parts-{t}";
consumer.subscribe({unknown, "parts-{u}"});
p.produce(T, 1);
Run("NATION_{n}", "NO_SUCH_PROC");
redisCommand(c, "SET sup:%d:{m} 1", id);
redisCommand(c, "GET %s", id);
q("select a from "
  "geo.region_{r} where 1 = 1");
q("insert into :t values (1)");
q("EXEC RATE_{n}");
"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers' numbers and nations, dealt to all tasks: they are few bytes, which a scan leaves to one task, but each becomes a file to be lexed."""
    few = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return few.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lang = F.when(k % 3 == 0, "go").when(k % 3 == 1, "rust").otherwise("cpp")
    text = F.when(k % 3 == 0, _GO).when(k % 3 == 1, _RUST).otherwise(_CPP)
    for name, value in (("t", k % 10), ("n", F.col("s_nationkey")), ("u", (k + 1) % 10), ("m", k % 3), ("r", k % 5), ("f", k % 4)):
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    path = F.concat(F.lit("/s"), k.cast("string"), F.lit("/main."), F.when(k % 3 == 0, "go").when(k % 3 == 1, "rs").otherwise("cpp"))
    return suppliers(spark, sf_dir).select(F.format_string("S%d", k).alias("service"), (k + 1).cast("int").alias("source_ord"), path.alias("path"), lang.alias("lang"), text.alias("content"))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("kind", "src", "dst", "path", "line")


_SUP = """s AS (SELECT s_suppkey AS k, s_nationkey AS n, s_suppkey % 3 AS l, 'S' || s_suppkey AS svc, '/s' || s_suppkey || '/main.' || ['go', 'rs', 'cpp'][s_suppkey % 3 + 1] AS path FROM supplier)"""
_NAT = """n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'GEO.NATION_' || n_nationkey AS proc, 'RATE_' || n_nationkey AS func, '/core/nation_' || n_nationkey || '.sql' AS path FROM nation)"""
_TOPICS = """SELECT 'Publishes' AS kind, svc AS src, 'parts-' || (k % 10) AS dst, path, 3 AS line FROM s UNION ALL SELECT 'Consumes', svc, 'parts-' || ((k + 1) % 10), path, [4, 2, 2][l + 1] FROM s"""
_KEYS = """SELECT 'WritesKey' AS kind, svc AS src, 'sup:*:' || (k % 3) AS dst, path, [6, 5, 5][l + 1] AS line FROM s
UNION ALL SELECT CASE l WHEN 0 THEN 'WritesKey' ELSE 'ReadsKey' END, svc, 'cfg:' || (k % 4), path, [9, 6][l + 1] FROM s WHERE l < 2"""
_EMBEDDED = """SELECT 'Touches' AS kind, svc AS src, 'REGION_' || (k % 5) AS dst, path, [7, 8, 7][l + 1] AS line FROM s UNION ALL SELECT 'Invokes', svc, 'RATE_' || n, path, [12, 10, 10][l + 1] FROM s"""


@register("x_definitions", f"""WITH {_NAT} SELECT 'GEO' AS schema, 'NATION_' || k AS title, 'Procedure' AS kind, 4 AS line_start, 8 AS line_end, 'CREATE OR REPLACE PROCEDURE geo.NATION_' || k || '(p IN NUMBER)' AS signature FROM n
UNION ALL SELECT NULL, func, 'Function', 9, 9, 'create function RATE_' || k || '(p number)' FROM n""")
def x_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plsql.definitions(sql_files(spark, sf_dir)).select("schema", "title", "kind", "line_start", "line_end", "signature")


@register("x_owns", f"WITH {_NAT} SELECT 'Owns' AS kind, 'core' AS src, proc AS dst, path, 4 AS line FROM n UNION ALL SELECT 'Owns', 'core', func, path, 9 FROM n")
def x_owns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(plsql.owns(plsql.definitions(sql_files(spark, sf_dir))))


@register("x_dynamic_sql", f"WITH {_NAT} SELECT 'Touches' AS kind, proc AS src, 'REGION_' || r AS dst, path, 6 AS line FROM n UNION ALL SELECT 'Calls', proc, 'NATION_' || ((k + 1) % 25), path, 7 FROM n")
def x_dynamic_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(plsql.dynamic_edges(plsql.definitions(sql_files(spark, sf_dir))))


@register("x_dictionary", f"WITH {_NAT} SELECT 'Touches' AS kind, 'CORE.' || func AS src, 'CORE.TRATES_' || (k % 3) AS dst, '<dictionary>' AS path, 0 AS line FROM n UNION ALL SELECT 'Calls', 'CORE.NATION_' || k, 'CORE.' || func, '<dictionary>', 0 FROM n")
def x_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(dictionary.dump_edges(dictionary.dump_rows(dump_lines(spark, sf_dir)), "core"))


@register("x_dictionary_rows", """SELECT DISTINCT 'S' || l_suppkey AS name, 'PROCEDURE' AS type, 'P' || l_partkey AS ref_name, 'TABLE' AS ref_type FROM lineitem WHERE l_linenumber % 2 = 1
UNION SELECT 'C' || c_custkey, 'FUNCTION', 'CALL_' || c_nationkey, 'PROCEDURE' FROM customer WHERE c_custkey % 3 = 0""")
def x_dictionary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary query over lines as references, some of other schemas, and customers as source text, some with key words only."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    k = F.col("c_custkey")
    refs = t("lineitem").select(F.format_string("S%d", "l_suppkey").alias("name"), F.lit("PROCEDURE").alias("type"), F.format_string("P%d", "l_partkey").alias("referenced_name"), F.lit("TABLE").alias("referenced_type"), F.when(F.col("l_linenumber") % 2 == 1, "OWN").otherwise("OTHER").alias("owner"), F.lit("OWN").alias("referenced_owner"))
    text = F.when(k % 3 == 0, F.format_string("x Begin  call_%d (1)", "c_nationkey")).when(k % 3 == 1, F.lit("begin if (1)")).otherwise(F.lit("begin no_call;"))
    return dictionary.dictionary_rows(refs, t("customer").select(F.format_string("C%d", k).alias("name"), F.lit("FUNCTION").alias("type"), text.alias("text"), F.lit("OWN").alias("owner")), "own")


@register("x_topics", f"WITH {_SUP} {_TOPICS}")
def x_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(messages.topic_edges(messages.topic_sites(code_files(spark, sf_dir))))


@register("x_unresolved", f"WITH {_SUP} SELECT svc || ':' || path AS loc, [4, 2, 2][l + 1] AS line FROM s")
def x_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.unresolved(messages.topic_sites(code_files(spark, sf_dir))).select("loc", "line")


@register("x_invokes", f"""WITH {_SUP} SELECT 'Invokes' AS kind, svc AS src, unnest(['NATION_' || n, 'NO_SUCH_PROC']) AS dst, path, [5, 4, 4][l + 1] AS line FROM s
UNION ALL SELECT 'Invokes', svc, unnest(['CALL', 'RATE_' || n]), path, 10 FROM s WHERE l = 1 UNION ALL SELECT 'Invokes', svc, unnest(['EXEC', 'RATE_' || n]), path, 10 FROM s WHERE l = 2
UNION ALL SELECT 'Invokes', svc, 'SET', path, 5 FROM s WHERE l = 2 UNION ALL SELECT 'Invokes', svc, 'GET', path, 6 FROM s WHERE l = 2""")
def x_invokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(messages.invokes(code_files(spark, sf_dir)))


@register("x_embedded_sql", f"WITH {_SUP} {_EMBEDDED}")
def x_embedded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(embedded_sql.sql_edges(embedded_sql.sql_literals(embedded_sql.string_literals(code_files(spark, sf_dir)))))


@register("x_dynamic_tables", f"WITH {_SUP} SELECT sum([2, 1, 1][l + 1])::BIGINT AS dynamic_tables FROM s")
def x_dynamic_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded_sql.dynamic_count(embedded_sql.sql_literals(embedded_sql.string_literals(code_files(spark, sf_dir))))


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return cache_keys.accesses(cache_keys.calls(files), cache_keys.wrappers(files))


@register("x_cache_keys", f"WITH {_SUP} {_KEYS}")
def x_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(cache_keys.key_edges(_accesses(spark, sf_dir)))


@register("x_key_wrappers", f"WITH {_SUP} SELECT svc AS service, 'Put' AS method, 'WritesKey' AS kind, 1 AS idx FROM s WHERE l = 0")
def x_key_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_keys.wrappers(code_files(spark, sf_dir))


@register("x_dynamic_keys", f"""WITH {_SUP} SELECT svc AS service, 'ReadsKey' AS kind, [10, 7, 6][l + 1] AS line FROM s UNION ALL SELECT svc, 'WritesKey', 8 FROM s WHERE l = 0""")
def x_dynamic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses whose key can't be told."""
    return _accesses(spark, sf_dir).where("key is null").select("service", "kind", "line")


# Verbs that read and verbs that write, stated apart from those of the operator.
_VERBS_SQL = """SELECT unnest(string_split('GET GETEX GETRANGE MGET STRLEN EXISTS TYPE TTL PTTL HGET HGETALL HMGET HKEYS HVALS HEXISTS HLEN LRANGE LINDEX LLEN LPOS SMEMBERS SISMEMBER SCARD SRANDMEMBER ZRANGE ZSCORE ZRANK ZCARD ZRANGEBYSCORE ZCOUNT KEYS SCAN BITCOUNT DUMP', ' ')) AS verb, 'ReadsKey' AS kind
  UNION ALL SELECT unnest(string_split('SET SETEX SETNX SETXX MSET MSETNX GETSET GETDEL APPEND DEL UNLINK EXPIRE EXPIREAT PEXPIRE PERSIST RENAME RENAMENX SETRANGE SETBIT INCR INCRBY DECR DECRBY INCRBYFLOAT HSET HMSET HSETNX HDEL HINCRBY HINCRBYFLOAT LPUSH RPUSH LPUSHX RPUSHX LPOP RPOP LSET LREM LTRIM SADD SREM SPOP SMOVE ZADD ZREM ZINCRBY ZREMRANGEBYSCORE', ' ')), 'WritesKey'"""
_COMMANDS = (*cache_keys.READ_VERBS, *cache_keys.WRITE_VERBS, "PUBLISH", "AUTH")


@register("x_key_verbs", f"""WITH verbs AS ({_VERBS_SQL}), said AS (SELECT {list(_COMMANDS)}[(event_id % {len(_COMMANDS)})::INTEGER + 1] AS verb, 'k:' || event_type || ':' || user_id % 7 AS key FROM events)
SELECT kind, key, count(*)::BIGINT AS n FROM said JOIN verbs USING (verb) GROUP BY kind, key""")
def x_key_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command for each event, whose verb goes by the event's number; 500 commands a file."""
    verb = F.element_at(F.array(*[F.lit(v.lower()) for v in _COMMANDS]), (F.col("event_id") % len(_COMMANDS)).cast("int") + 1)
    line = F.concat(F.lit('redis::cmd("'), verb, F.lit('").arg("k:'), "event_type", F.lit(":"), (F.col("user_id") % 7).cast("string"), F.lit('");'))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 500).alias("f"), "event_id", line.alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    files = events.groupBy("f").agg(text.alias("content")).select(F.lit("s").alias("service"), F.lit(0).alias("source_ord"), F.format_string("/s/v%d.rs", "f").alias("path"), F.lit("rust").alias("lang"), "content")
    found = cache_keys.key_edges(cache_keys.accesses(cache_keys.calls(files), cache_keys.wrappers(files)))
    return found.groupBy("kind", F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("n"))


_BUILT: dict[tuple[str, str], tuple[Store, DataFrame]] = {}


def built(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """The whole tree through the sync, with a registry of one service that consumes and one topic's provenance; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        files = code_files(spark, sf_dir)
        services = files.select(F.array(F.lit("2"), F.format_string("%06d", "source_ord")).alias("seq"), "service")
        registry = spark.createDataFrame([("S1", ["parts-1"], ["parts-0", "parts-2"], {"parts-1": ["REGION_0", "NO_SUCH_TABLE"]})], REGISTRY)
        coverage = spark.createDataFrame([("core", True)], "service string, has_dump boolean")
        dumps = [dictionary.dump_edges(dictionary.dump_rows(dump_lines(spark, sf_dir)), "core")]
        _BUILT[key] = build(spark, sql_files(spark, sf_dir), files, dumps, services, registry, coverage)
    return _BUILT[key]


_TREE = f"""{_SUP}, {_NAT}, e AS (
  SELECT 'Owns' AS kind, 'core' AS src, proc AS dst, path, 4 AS line FROM n UNION ALL SELECT 'Owns', 'core', func, path, 9 FROM n
  UNION ALL SELECT 'Touches', proc, 'REGION_' || r, path, 6 FROM n UNION ALL SELECT 'Calls', proc, 'GEO.NATION_' || ((k + 1) % 25), path, 7 FROM n
  UNION ALL SELECT 'Touches', func, 'CORE.TRATES_' || (k % 3), '<dictionary>', 0 FROM n UNION ALL SELECT 'Calls', proc, func, '<dictionary>', 0 FROM n
  UNION ALL {_TOPICS} UNION ALL {_KEYS} UNION ALL SELECT kind, src, dst, path, line FROM ({_EMBEDDED})
  UNION ALL SELECT 'Invokes', svc, 'GEO.NATION_' || n, path, [5, 4, 4][l + 1] FROM s UNION ALL SELECT 'Consumes', 'S1', 'parts-0', '<registry>', 0
)"""


@register("sync_edges", f"""WITH {_TREE} SELECT kind, src, dst, path, line, CASE WHEN kind = 'Publishes' AND src = 'S1' AND dst = 'parts-1' THEN 'REGION_0' ELSE '' END AS provenance FROM e""")
def sync_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with the keys of their ends, and of the tables of their provenance."""
    store, _ = built(spark, sf_dir)
    keys = store.nodes.select("id", F.concat_ws(".", "schema", "name").alias("key"))
    named = store.edges.join(keys.toDF("src", "s"), "src").join(keys.toDF("dst", "d"), "dst").join(keys.select(F.array("id").alias("p"), F.col("key").alias("t")), F.slice("provenance", 1, 1) == F.col("p"), "left")
    return named.select("kind", F.col("s").alias("src"), F.col("d").alias("dst"), "path", "line", F.coalesce("t", F.lit("")).alias("provenance"))


@register("sync_nodes", f"""WITH {_TREE}, m AS (
  SELECT proc AS key, 'Procedure' AS kind, true AS defined FROM n UNION SELECT func, 'Function', true FROM n
  UNION SELECT svc, 'Service', false FROM s UNION SELECT 'core', 'Service', false UNION SELECT dst, 'Table', false FROM e WHERE kind = 'Touches'
  UNION SELECT dst, 'Topic', false FROM e WHERE kind IN ('Publishes', 'Consumes') UNION SELECT dst, 'RedisKey', false FROM e WHERE kind IN ('WritesKey', 'ReadsKey')
) SELECT key, kind, defined FROM m""")
def sync_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = built(spark, sf_dir)[0].nodes
    return nodes.select(F.concat_ws(".", "schema", "name").alias("key"), "kind", (F.col("kind").isin(*SQL_KINDS) & F.col("chunk").isNotNull()).alias("defined"))


@register("sync_node_ids", f"""WITH {_NAT}, {_SUP}, d AS (SELECT proc AS key, 0 AS phase, path AS a, 0 AS b FROM n UNION ALL SELECT func, 0, path, 1 FROM n UNION ALL SELECT svc, 1, lpad((k + 1)::VARCHAR, 6, '0'), 0 FROM s)
SELECT (row_number() OVER (ORDER BY phase, a, b) - 1)::BIGINT AS id, key FROM d""")
def sync_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids follow first appearance: definitions by file and place, then services in the order of sources."""
    nodes = built(spark, sf_dir)[0].nodes.withColumn("key", F.concat_ws(".", "schema", "name"))
    return nodes.where("chunk is not null or (kind = 'Service' and name <> 'core')").select("id", "key")


@register("sync_chunks", f"""WITH {_NAT}, c AS (SELECT proc AS node, path, 4 AS line_start, 8 AS line_end FROM n UNION ALL SELECT func, path, 9, 9 FROM n)
SELECT (row_number() OVER (ORDER BY path, line_start) - 1)::BIGINT AS id, node, path, line_start, line_end FROM c""")
def sync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = built(spark, sf_dir)
    keys = store.nodes.select(F.col("id").alias("node"), F.concat_ws(".", "schema", "name").alias("key"))
    return store.chunks.join(keys, "node").select("id", F.col("key").alias("node"), "path", "line_start", "line_end")


@register("sync_report", f"""WITH {_TREE} SELECT (SELECT count(*) + 1 FROM s)::BIGINT AS services, (SELECT 2 * count(*) FROM n)::BIGINT AS defs, (SELECT count(*) FROM e)::BIGINT AS edges, (SELECT count(*) FROM s)::BIGINT AS unresolved,
  (SELECT sum([1, 2, 4][l + 1]) FROM s)::BIGINT AS invokes_dropped, (SELECT sum([2, 1, 1][l + 1]) FROM s)::BIGINT AS dynamic_tables, (SELECT sum([2, 1, 1][l + 1]) FROM s)::BIGINT AS dynamic_keys""")
def sync_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir)[1]


@register("tree_topic_ends", f"""WITH {_SUP} SELECT (SELECT string_agg(svc || ' (' || path || ':3)', '; ' ORDER BY k) FROM s WHERE k % 10 = 0) AS producers,
  concat_ws('; ', (SELECT string_agg(svc || ' (' || path || ':' || [4, 2, 2][l + 1] || ')', '; ' ORDER BY k) FROM s WHERE k % 10 = 9), 'S1 (<registry>:0)') AS consumers""")
def tree_topic_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = built(spark, sf_dir)
    topic = lookup.find(store.nodes, "PARTS-0").first()
    return graph.topic_ends(store.edges, store.nodes, topic.id)


def _near(spark: SparkSession, sf_dir: str, name: str, steps) -> DataFrame:
    store, _ = built(spark, sf_dir)
    made = steps(store.edges)
    found = graph.all_reached(made, lookup.find(store.nodes, name).first().id, 1)
    return graph.decorate(found, store.nodes, store.edges, few=False).select("key", "node_kind", "depth", "via_kind", "path", "line")


@register("tree_callers", f"""WITH {_TREE} SELECT src AS key, CASE WHEN kind = 'Calls' THEN 'Procedure' ELSE 'Service' END AS node_kind, 1 AS depth, kind AS via_kind, path, line FROM e WHERE dst = 'GEO.NATION_3' AND kind <> 'Owns'""")
def tree_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "geo.nation_3", graph.upstream_steps)


@register("tree_dependencies", f"""WITH {_TREE} SELECT dst AS key, CASE kind WHEN 'Touches' THEN 'Table' WHEN 'Invokes' THEN CASE WHEN dst LIKE 'RATE%' THEN 'Function' ELSE 'Procedure' END WHEN 'WritesKey' THEN 'RedisKey' WHEN 'ReadsKey' THEN 'RedisKey' ELSE 'Topic' END AS node_kind,
  1 AS depth, kind AS via_kind, path, line FROM e WHERE src = 'S1'""")
def tree_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, "s1", graph.downstream_steps)


def diff_text(spark: SparkSession, sf_dir: str) -> str:
    """A diff that changes a line of each nation's procedure, some with a count of lines, and of one supplier's file; a diff is a text of the driver."""
    parts = []
    for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect():
        name = f"core/nation_{r.n_nationkey}.sql"
        parts.append(f"diff --git a/{name} b/{name}\n--- a/{name}\n+++ b/{name}\n" + ("@@ -6,1 +6,1 @@\n-old\n+new\n" if r.n_nationkey % 2 else "@@ -9 +9 @@\n-old\n+new\n"))
    return "".join(parts) + "diff --git a/s1/main.rs b/s1/main.rs\n--- a/s1/main.rs\n+++ b/s1/main.rs\n@@ -2 +2,2 @@\n-old\n+++ new\n+more\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-x\n"


@register("diff_hunks", """SELECT 'core/nation_' || n_nationkey || '.sql' AS file, CASE WHEN n_nationkey % 2 = 1 THEN 6 ELSE 9 END AS start, CASE WHEN n_nationkey % 2 = 1 THEN 6 ELSE 9 END AS "end" FROM nation UNION ALL SELECT 's1/main.rs', 2, 3""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.hunks(spark, diff_text(spark, sf_dir)).select("file", "start", "end")


@register("diff_changed", f"""WITH {_NAT} SELECT CASE WHEN k % 2 = 1 THEN proc ELSE func END AS name, CASE WHEN k % 2 = 1 THEN 'Procedure' ELSE 'Function' END AS kind, CASE WHEN k % 2 = 1 THEN '6-6' ELSE '9-9' END AS lines, 'chunk overlap' AS source FROM n
UNION ALL SELECT proc, 'Procedure', '9-9', 'edge path' FROM n WHERE k % 2 = 0
UNION ALL SELECT 'S' || s_suppkey, 'Service', '2-3', 'edge path' FROM supplier WHERE s_suppkey = 1""")
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that hunks overlap, and what edges of a changed file start from."""
    store, _ = built(spark, sf_dir)
    return diff.changed_symbols(diff.hunks(spark, diff_text(spark, sf_dir)), store.nodes, store.edges, store.chunks).select("name", "kind", "lines", "source")
