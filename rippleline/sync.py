"""Sync: from a configuration to a store."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rippleline.operators import cache_keys, embedded_sql, messages, plsql
from rippleline.operators.assemble import assemble
from rippleline.operators.lookup import first_coverage
from rippleline.runtime import materialize
from rippleline.schema import FILES, RAW_DEFS, RAW_EDGES
from rippleline.sources.config import Config, read_registry
from rippleline.sources.dictionary import dump_edges, dump_path, read_dump
from rippleline.sources.files import read_tree, scan_tree, unreadable
from rippleline.sources.store import Store
from rippleline.sources.tree import pruned_tree


COUNTERS = ("services", "defs", "edges", "unresolved", "invokes_dropped", "dynamic_tables", "dynamic_keys")


@dataclass(frozen=True)
class Report:
    services: int
    defs: int
    edges: int
    unresolved: int
    invokes_dropped: int
    dynamic_tables: int
    dynamic_keys: int
    unreadable: int


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def build(spark: SparkSession, sql_files: DataFrame, code_files: DataFrame, dumps: list[DataFrame], services: DataFrame, registry: DataFrame, coverage: DataFrame) -> tuple[Store, DataFrame]:
    """files of SQL and of code, raw edges of dumps, services(seq, service), registry, coverage(service, has_dump) -> the store's tables and
    one row of counters, which are observed as the tables are written and cost no pass. Files are read once, and each extractor works on the same written table of them."""
    files = materialize(code_files, "files")
    every, seen = F.count(F.lit(1)), {name: Observation() for name in ("defs", "unresolved", "dynamic_tables", "dynamic_keys")}
    defs = materialize(plsql.definitions(sql_files).select(*[c.split()[0] for c in RAW_DEFS.split(", ")]), "definitions", seen["defs"], defs=every)
    sites = messages.topic_sites(files)
    sql = materialize(embedded_sql.sql_literals(embedded_sql.string_literals(files)), "sql-literals", seen["dynamic_tables"], dynamic_tables=embedded_sql.dynamic_total())
    keys = materialize(cache_keys.accesses(cache_keys.calls(files), cache_keys.wrappers(files)), "key-accesses", seen["dynamic_keys"], dynamic_keys=F.count_if(F.col("key").isNull()))
    raw = _union([plsql.owns(defs), plsql.dynamic_edges(defs), *dumps, messages.topic_edges(sites), messages.invokes(files), embedded_sql.sql_edges(sql), cache_keys.key_edges(keys)], spark, RAW_EDGES)
    made = assemble(services, defs, raw, registry)
    unresolved = materialize(messages.unresolved(sites), "unresolved", seen["unresolved"], unresolved=every)
    counts = made.counts | {k: v for o in seen.values() for k, v in o.get.items()}
    counters = spark.createDataFrame([tuple(counts[x] for x in COUNTERS)], ", ".join(f"{x} long" for x in COUNTERS))
    meta = spark.createDataFrame([(int(time.time()),)], "synced_at long")
    return Store(made.nodes, made.edges, made.chunks, unresolved, coverage, meta), counters


def sync(spark: SparkSession, config: Config) -> tuple[Store, Report]:
    """Read what a configuration names, and build."""
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    exists = lambda p: fs(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs(p))
    scan = pruned_tree if config.listing == "pruned" else scan_tree
    sql_parts, code_parts, dumps, coverage, services = [], [], [], [], []
    for i, source in enumerate(config.sources):
        if source.kind == "sql":
            sql_parts.append(read_tree(spark, source.path, source.service, i, ("sql",), strict=True, scan=scan))
            dump = dump_path(config.store, source.service)
            found = exists(dump)
            if found:
                dumps.append(dump_edges(read_dump(spark, dump), source.service, i))
            coverage.append((i, source.service, found))
        else:
            code_parts.append(scan(spark, source.path, source.service, i))
            services.append((["2", f"{i:06d}"], source.service))
    scanned = materialize(_union(code_parts, spark, FILES), "scanned")
    covered = first_coverage(spark.createDataFrame(coverage, "source_ord int, service string, has_dump boolean"))
    named = spark.createDataFrame(services, "seq array<string>, service string")
    store, counters = build(spark, _union(sql_parts, spark, FILES), scanned.where("content is not null"), dumps, named, read_registry(spark, config.registry), covered)
    skipped = unreadable(scanned).agg(F.coalesce(F.sum("unreadable"), F.lit(0))).first()[0]
    return store, Report(**counters.first().asDict(), unreadable=skipped)
