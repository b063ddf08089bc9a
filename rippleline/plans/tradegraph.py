"""The trade graph: the driver's tables in the roles of tables, procedures, services, topics, functions and keys.

Region R is a table; nation N a procedure that touches it; supplier S and customer C services that invoke nations; part P a topic
that suppliers publish and customers consume; order O a function that a customer owns; event type K a key that customers read and
write. A published part of even size has one region as its provenance.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.operators import adjacency, names
from rippleline.operators.adjacency import Adjacency
from rippleline.operators.names import Names
from rippleline.runtime import materialize, table_path


class TradeGraph:
    """Edges are written once a session, when they are first asked for; what asks for nodes alone doesn't pay for them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.nodes = nodes(spark, sf_dir)

    @functools.cached_property
    def edges(self) -> DataFrame:
        return with_ids(materialize(edges(self.spark, self.sf_dir), "trade-edges"))

    def edges_of(self, *kinds: str) -> DataFrame:
        """Edges of some kinds, made of the tables that have them and not written: for kinds that come from small tables."""
        return with_ids(edges(self.spark, self.sf_dir).where(F.col("kind").isin(*kinds)))


def _id(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


#: Pairs of a task that takes out duplicates. Most pairs occur once, so that is done after the exchange alone, in as many tasks as lines ask for.
PAIRS_A_TASK = 1_000_000


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst, kind, path, line, provenance); each (kind, src, dst) once. Duplicates go before strings are made, in tasks whose
    memory doesn't grow with the tables."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = F.array().cast("array<string>")

    def edge(df: DataFrame, kind: Column | str, src: Column, dst: Column, path: str, provenance: Column = none) -> DataFrame:
        return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), src.alias("src"), dst.alias("dst"), F.lit(path).alias("path"), F.lit(1).alias("line"), provenance.alias("provenance"))

    def once(pairs: DataFrame, end: str, part: str) -> DataFrame:
        """A part's pairs meet in at most eight tasks: few enough to count most of them together, enough to spread a part that very many lines have."""
        slot = F.pmod(F.xxhash64(end), F.lit(8))  # made anew where rows arrive, so it isn't moved
        return pairs.repartition(tasks, part, slot).withColumn("_slot", slot).distinct().drop("_slot")

    lines = t("lineitem")
    tasks = max(spark.sparkContext.defaultParallelism, -(-lines.count() // PAIRS_A_TASK))
    part = t("part").select("p_partkey", "p_size")
    published = once(lines.select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    region = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("R"), (F.col("p_partkey") % 5).cast("string")))).otherwise(none)
    consumed = once(lines.select("l_orderkey", "l_partkey").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey"), "o_custkey", "l_partkey")
    keys = t("events").select("user_id", "event_type", F.when(F.col("event_id") % 2 == 0, "WritesKey").otherwise("ReadsKey").alias("kind")).distinct()
    out = (
        edge(t("nation"), "Touches", _id("N", "n_nationkey"), _id("R", "n_regionkey"), "nation")
        .union(edge(t("supplier"), "Invokes", _id("S", "s_suppkey"), _id("N", "s_nationkey"), "supplier"))
        .union(edge(t("customer"), "Invokes", _id("C", "c_custkey"), _id("N", "c_nationkey"), "customer"))
        .union(edge(published, "Publishes", _id("S", "l_suppkey"), _id("P", "l_partkey"), "lineitem", region))
        .union(edge(consumed, "Consumes", _id("C", "o_custkey"), _id("P", "l_partkey"), "lineitem"))
        .union(edge(t("orders"), "Owns", _id("C", "o_custkey"), _id("O", "o_orderkey"), "orders"))
        .union(edge(keys, F.col("kind"), _id("C", "user_id"), _id("K:", "event_type"), "events"))
    )
    return out


def with_ids(rows: DataFrame) -> DataFrame:
    """Edges with their ids, which are made of kind and ends and needn't be written."""
    return rows.withColumn("id", F.concat_ws("|", "kind", "src", "dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(id, name, schema, kind)."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = (
        ("Table", "R", t("region"), "r_regionkey", "r_name"), ("Procedure", "N", t("nation"), "n_nationkey", "n_name"),
        ("Service", "S", t("supplier"), "s_suppkey", "s_name"), ("Service", "C", t("customer"), "c_custkey", "c_name"),
        ("Topic", "P", t("part"), "p_partkey", "p_name"), ("Function", "O", t("orders"), "o_orderkey", "o_orderpriority"),
        ("RedisKey", "K:", t("events").select("event_type").distinct(), "event_type", "event_type"),
    )
    out = None
    for kind, prefix, df, key, name in parts:
        some = df.select(_id(prefix, key).alias("id"), F.col(name).cast("string").alias("name"), F.lit(None).cast("string").alias("schema"), F.lit(kind).alias("kind"))
        out = some if out is None else out.union(some)
    return out


_BUILT: dict[tuple[str, str], TradeGraph] = {}


def trade_graph(spark: SparkSession, sf_dir: str) -> TradeGraph:
    """One a session, so that no query's time or memory depends on another's."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = TradeGraph(spark, sf_dir)
    return _BUILT[key]


_NAMES: dict[tuple[str, str], Names] = {}


def trade_names(spark: SparkSession, sf_dir: str) -> Names:
    """The index of the graph's names, written once a session as a store keeps it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _NAMES:
        path = table_path(spark, "trade-names")
        names.write(trade_graph(spark, sf_dir).nodes, path)
        _NAMES[key] = names.read(spark, path)
    return _NAMES[key]


_STEPS: dict[tuple[str, str], Adjacency] = {}


def trade_steps(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The graph's adjacency, written once a session as a store keeps it; query graph_adjacency times it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STEPS:
        path = table_path(spark, "trade-steps")
        adjacency.write(trade_graph(spark, sf_dir).edges, path, by_ends=True)
        _STEPS[key] = adjacency.read(spark, path)
    return _STEPS[key]
