"""From definitions and raw edges to nodes and edges.

Node identity is by kind group: services, topics and keys by name as written; procedures, functions and tables by
upper-case SCHEMA.NAME. A reference to an SQL object is bound to the node with its full key, or else to the owner of its
bare name: the first definition with that title, or else the first reference with that bare name. So binding is two joins
and a first-of-each-key aggregation, whatever the number of references; ids follow first appearance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rippleline.functions.text import ascii_upper
from rippleline.operators.graph import numbered, rank_first
from rippleline.runtime import drop, materialize
from rippleline.schema import SQL_KINDS, edge_kinds


@dataclass(frozen=True)
class Assembled:
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    counts: dict[str, int]


def _group(kind):
    return F.when(kind.isin(*SQL_KINDS), F.lit("sql")).otherwise(kind)


def _split(name):
    """(schema, bare) of an SQL name: the schema is what stands before the first dot."""
    upper = ascii_upper(name)
    at = F.instr(upper, ".")
    return F.when(at > 0, F.substring(upper, F.lit(1), at - 1)), F.when(at > 0, F.substring(upper, at + 1, F.length(upper))).otherwise(upper)


def registry_edges(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Raw edges that the registry declares and code doesn't show: an anti-join on (kind, service, topic)."""
    each = None
    for i, (kind, column) in enumerate((("Publishes", "publishes"), ("Consumes", "consumes"))):
        some = registry.select("service", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "topic"), F.lit(i).alias("k"))
        each = some if each is None else each.unionByName(some)
    known = seen.where(F.col("kind").isin("Publishes", "Consumes")).select("kind", F.col("src").alias("service"), F.col("dst").alias("topic")).distinct()
    seq = F.array(F.lit("3"), F.col("service"), F.format_string("%d%06d", "k", "pos"))
    return each.join(known, ["kind", "service", "topic"], "left_anti").select(seq.alias("seq"), "kind", F.col("service").alias("src"), F.col("topic").alias("dst"), F.lit("<registry>").alias("path"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("from_kind"))


def shared_registry_edges(services: DataFrame, lists: DataFrame, seen: DataFrame, kind: str = "Publishes", per_block: int = 1024) -> DataFrame:
    """registry_edges() of one kind, of services that share lists: services(service, list), lists(list, topic), without nulls -> (kind, src, dst, path, line).
    Declared pairs are the product of both, so they are neither moved nor kept. Lists are cut into blocks of about `per_block` topics; what
    moves is a row a service and block, with what code shows of it, and pairs are made where such a row meets its block."""
    n = int(services.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks, however few bytes the blocks are
    at = ["list", "block"]
    sizes = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per_block).alias("blocks"))
    block = F.pmod(F.xxhash64("topic"), F.col("blocks")).alias("block")
    topics = lists.join(sizes, "list").select("list", block, "topic").repartition(n, *at).groupBy(*at).agg(F.collect_list("topic").alias("topics"))
    declaring = services.join(sizes, "list")
    shown = seen.where(F.col("kind") == kind).select(F.col("src").alias("service"), F.col("dst").alias("topic")).join(declaring.hint("merge"), "service")
    shown = shown.select("service", "list", block, "topic").groupBy("service", *at).agg(F.collect_set("topic").alias("shown"))
    wanted = declaring.select("service", "list", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(shown, ["service", *at], "left")
    pairs = wanted.repartition(n, *at).join(topics.hint("merge"), at).select("service", "shown", F.explode("topics").alias("topic"))
    gaps = pairs.where(F.col("shown").isNull() | ~F.array_contains("shown", F.col("topic")))
    return gaps.select(F.lit(kind).alias("kind"), F.col("service").alias("src"), F.col("topic").alias("dst"), F.lit("<registry>").alias("path"), F.lit(0).alias("line"))


def _references(raw: DataFrame, kinds: DataFrame) -> DataFrame:
    """Both ends of each raw edge: (seq, side, kind, key, bare)."""
    typed = raw.join(F.broadcast(kinds.withColumnRenamed("from_kind", "default_from")), "kind")
    both = typed.select("seq", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.coalesce("from_kind", "default_from").alias("kind"), F.col("src").alias("name")),
        F.struct(F.lit(1).alias("side"), F.col("to_kind").alias("kind"), F.col("dst").alias("name")),
    )).alias("end")).select("seq", "end.*")
    schema, bare = _split(F.col("name"))
    is_sql = F.col("kind").isin(*SQL_KINDS)
    return both.select(
        "seq", "side", "kind", _group(F.col("kind")).alias("grp"),
        F.when(is_sql, F.concat_ws(".", schema, bare)).otherwise(F.col("name")).alias("key"),
        F.when(is_sql, bare).otherwise(F.col("name")).alias("bare"), F.when(is_sql, schema).alias("schema"),
    )


def flagged(raw: DataFrame, names: DataFrame) -> DataFrame:
    """Raw edges to what may be noise, names(key, bare) of what is known -> the edges with `known`: whether the target is known by its full key or
    by its bare name. Two left joins, and a flag."""
    schema, bare = _split(F.col("dst"))
    known = names.select(F.col("key").alias("_t")).union(names.select("bare")).distinct()
    wanted = raw.withColumn("_key", F.concat_ws(".", schema, bare)).withColumn("_bare", bare)
    found = wanted.join(known.select(F.col("_t").alias("_key"), F.lit(True).alias("_by_key")), "_key", "left").join(known.select(F.col("_t").alias("_bare"), F.lit(True).alias("_by_bare")), "_bare", "left")
    return found.select(*raw.columns, (F.col("_by_key").isNotNull() | F.col("_by_bare").isNotNull()).alias("known"))


def gate(raw: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges whose target is known, one row with invokes_dropped)."""
    found = flagged(raw, names)
    return found.where("known").drop("known"), found.agg(F.count_if(~F.col("known")).alias("invokes_dropped"))


def assemble(services: DataFrame, defs: DataFrame, raw: DataFrame, registry: DataFrame) -> Assembled:
    """services(seq, service), raw definitions, raw edges (all phases but the registry's), registry."""
    spark = raw.sparkSession
    kinds = edge_kinds(spark)
    raw = materialize(raw, "raw")
    defs = materialize(defs.withColumn("key", F.concat_ws(".", "schema", "title")).withColumn("seq", F.array(F.lit("0"), F.format_string("%06d", "source_ord"), F.col("path"), F.format_string("%09d", "pos"))), "defs")

    # Invokes are let in only if they name a known procedure or function, and come after all others, as their targets must be there first.
    is_invoke = F.col("kind") == "Invokes"
    dropped, services_seen, kept = Observation(), Observation(), Observation()
    admitted = flagged(raw.where(is_invoke), defs.select("key", F.col("title").alias("bare"))).observe(dropped, F.count_if(~F.col("known")).alias("invokes_dropped")).where("known").drop("known")
    edges = raw.where(~is_invoke).unionByName(registry_edges(registry, raw)).unionByName(admitted.withColumn("seq", F.concat(F.array(F.lit("4")), "seq")))
    edges = materialize(edges, "admitted")
    ends = _references(edges, kinds)

    # Who owns a bare SQL name: a definition before any reference, then what comes first.
    at_def = F.struct(F.lit(0).alias("later"), "seq", F.lit(0).alias("side"))
    at_ref = F.struct(F.lit(1).alias("later"), "seq", "side")
    defined = defs.select("key", F.col("title").alias("bare"), "schema", "kind", at_def.alias("at"))
    referred = ends.where("grp = 'sql'").select("key", "bare", "schema", "kind", at_ref.alias("at"))
    owner = rank_first(defined.union(referred).select("bare", "key", "at"), ["bare"], ["at"]).select("bare", F.col("key").alias("owner"))
    exact = defs.select("key").distinct().withColumn("exact", F.lit(True))
    sql = ends.where("grp = 'sql'").join(exact, "key", "left").join(owner, "bare", "left")
    bound = sql.select("seq", "side", "kind", "grp", F.when(F.col("exact"), F.col("key")).otherwise(F.coalesce("owner", "key")).alias("key"))
    bound = materialize(bound.unionByName(ends.where("grp <> 'sql'").select("seq", "side", "kind", "grp", "key")), "bound")

    # Nodes: definitions, services, then what edges name, each by its first appearance.
    from_defs = defined.select(F.lit("sql").alias("grp"), "key", "bare", "schema", "kind", F.struct(F.lit("0").alias("phase"), F.col("at.seq").alias("seq"), F.col("at.side").alias("side")).alias("at"))
    from_services = services.select(F.lit("Service").alias("grp"), F.col("service").alias("key"), F.col("service").alias("bare"), F.lit(None).cast("string").alias("schema"), F.lit("Service").alias("kind"), F.struct(F.lit("1").alias("phase"), "seq", F.lit(0).alias("side")).alias("at"))
    schema, bare = _split(F.col("key"))
    is_sql = F.col("grp") == "sql"
    from_edges = bound.select("grp", "key", F.when(is_sql, bare).otherwise(F.col("key")).alias("bare"), F.when(is_sql, schema).alias("schema"), "kind", F.struct(F.lit("2").alias("phase"), "seq", "side").alias("at"))
    first = rank_first(from_defs.union(from_services).union(from_edges), ["grp", "key"], ["at"])
    named = materialize(numbered(first, ["at", "grp", "key"]).drop("at"), "numbered")

    # Chunks: one a definition; a node points to its first.
    chunks = numbered(defs, ["seq"]).join(named.where("grp = 'sql'").select("key", F.col("id").alias("node")), "key")
    chunks = materialize(chunks.select("id", "service", "path", "kind", "title", "line_start", "line_end", "signature", "body", "node"), "chunks")
    of_node = chunks.groupBy("node").agg(F.min("id").alias("chunk"))
    nodes = named.join(of_node, named["id"] == of_node["node"], "left").select("id", F.col("bare").alias("name"), "schema", "kind", "chunk")
    nodes = materialize(nodes, "nodes", services_seen, services=F.count_if(F.col("kind") == "Service"))

    # Edges: ids of both ends, no loops, the first evidence of each (kind, src, dst). Both ends of an edge meet in one aggregation by seq.
    placed = bound.join(named.select("grp", "key", F.col("id").alias("node")), ["grp", "key"])
    both = placed.groupBy("seq").agg(F.max(F.when(F.col("side") == 0, F.col("node"))).alias("src"), F.max(F.when(F.col("side") == 1, F.col("node"))).alias("dst"))
    tied = edges.select("seq", "kind", "path", "line").join(both, "seq").where("src <> dst")
    unique = numbered(rank_first(tied, ["kind", "src", "dst"], ["seq"]), ["seq"]).select("id", "src", "dst", "kind", "path", "line")
    unique = materialize(provenance(unique, nodes, registry), "edges", kept, edges=F.count(F.lit(1)))
    drop(bound)
    return Assembled(nodes, unique, chunks, {**dropped.get, **services_seen.get, **kept.get})


def provenance(edges: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """edges with provenance: table ids that the registry declares for a (service, topic). Names that are no table are
    left out; with none left, the edge is unconstrained."""
    declared = registry.select("service", F.explode("provenance").alias("topic", "tables")).select("service", "topic", F.explode("tables").alias("table"))
    schema, bare = _split(F.col("table"))
    declared = declared.select("service", "topic", F.concat_ws(".", schema, bare).alias("key"), bare.alias("bare"))
    tables = nodes.where("kind = 'Table'").select(F.concat_ws(".", "schema", "name").alias("key"), F.col("name").alias("bare"), F.col("id").alias("table_id"))
    exact = tables.select("key", F.col("table_id").alias("exact_id"))
    by_bare = tables.groupBy("bare").agg(F.min("table_id").alias("bare_id"))
    found = declared.join(exact, "key", "left").join(by_bare, "bare", "left").select("service", "topic", F.coalesce("exact_id", "bare_id").alias("table_id")).where("table_id is not null")
    listed = found.groupBy("service", "topic").agg(F.array_sort(F.collect_set("table_id")).alias("provenance"))
    names = nodes.select("id", "name")
    ends = listed.join(names.select(F.col("id").alias("src"), F.col("name").alias("service")).join(nodes.where("kind = 'Service'").select(F.col("id").alias("src")), "src", "left_semi"), "service")
    ends = ends.join(nodes.where("kind = 'Topic'").select(F.col("id").alias("dst"), F.col("name").alias("topic")), "topic")
    ends = ends.select("src", "dst", F.lit("Publishes").alias("kind"), "provenance")
    return edges.join(ends, ["src", "dst", "kind"], "left").select("id", "src", "dst", "kind", "path", "line", F.coalesce("provenance", F.array().cast("array<long>")).alias("provenance"))
