"""The store: versioned Parquet tables. A save writes a new version folder and then points to it, so readers
see either the old graph or the new one.

A reader leases the version it reads, by a file in the store that names the version and when the lease ends. Pruning leaves leased versions
alone; a reader that dies without giving its lease back holds it until then. Clocks of readers and pruners may differ by less than a lease's time."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.operators import adjacency, names
from rippleline.operators.adjacency import Adjacency
from rippleline.operators.names import Names
from rippleline.schema import STORE_VERSION

#: Seconds that a lease holds, unless it is given back before.
HOLD = 24 * 3600.0
TABLES = ("nodes", "edges", "chunks", "unresolved", "sql_coverage", "meta")


@dataclass(frozen=True)
class Store:
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    unresolved: DataFrame
    sql_coverage: DataFrame
    meta: DataFrame
    steps: Adjacency | None = None
    names: Names | None = None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(store: Store, path: str) -> str:
    """Edges are laid out by kind and then by where they end, so that questions about some kinds read only those; a kind of any size is spread
    over tasks. Searches use the adjacency, which is written beside them in both directions, and names their index."""
    spark = store.nodes.sparkSession
    version = f"v{time.time_ns():020d}"
    for name in TABLES:
        df = getattr(store, name)
        if name == "meta":
            df = df.withColumn("version", F.lit(STORE_VERSION))
        writer = df.write
        if name == "edges":
            writer = df.repartitionByRange("kind", "dst", "id").sortWithinPartitions("kind", "dst", "id").write.partitionBy("kind")
        writer.parquet(f"{path}/{version}/{name}")
    adjacency.write(spark.read.parquet(f"{path}/{version}/edges").withColumn("kind", F.col("kind").cast("string")), f"{path}/{version}/steps")
    names.write(spark.read.parquet(f"{path}/{version}/nodes"), f"{path}/{version}/names")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{version}/_done")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions, oldest first."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_done/_SUCCESS"))
    return sorted(n for n in names if n.startswith("v") and done(n))


def load(spark: SparkSession, path: str, version: str | None = None) -> Store:
    """A version of the store, or else its newest."""
    found = [version] if version else versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no store at {path}: run sync first")
    at = f"{path}/{found[-1]}"
    meta = spark.read.parquet(f"{at}/meta")
    if (written := meta.first().version) != STORE_VERSION:
        raise ValueError(f"store version {written}, expected {STORE_VERSION}: run sync again")
    tables = {name: spark.read.parquet(f"{at}/{name}") for name in TABLES}
    tables["edges"] = tables["edges"].select("id", "src", "dst", F.col("kind").cast("string").alias("kind"), "path", "line", "provenance")
    return Store(**tables, steps=adjacency.read(spark, f"{at}/steps"), names=names.read(spark, f"{at}/names"))


def acquire(spark: SparkSession, path: str, hold: float = HOLD) -> tuple[str, str]:
    """Lease the newest version for some seconds: (version, lease). The lease is written first and the version looked for again afterwards, as
    prune() hides a version first and looks for leases afterwards; so one of both sees the other."""
    while found := versions(spark, path):
        lease = f"{path}/_leases/{found[-1]}.{int((time.time() + hold) * 1000)}.{uuid.uuid4().hex}"
        fs, p = _fs(spark, lease)
        fs.create(p, False).close()
        if found[-1] in versions(spark, path):
            return found[-1], lease
        release(spark, lease)
    raise FileNotFoundError(f"no store at {path}: run sync first")


def release(spark: SparkSession, lease: str) -> None:
    fs, p = _fs(spark, lease)
    fs.delete(p, False)


def leased(spark: SparkSession, path: str) -> set[str]:
    """Versions with a lease that hasn't ended. Leases that have are deleted."""
    fs, p = _fs(spark, f"{path}/_leases")
    held, now = set(), time.time() * 1000
    for status in fs.listStatus(p) if fs.exists(p) else ():
        version, until, _ = status.getPath().getName().split(".")
        if int(until) > now:
            held.add(version)
        else:
            fs.delete(status.getPath(), False)
    return held


def prune(spark: SparkSession, path: str, keep: int = 2, min_age: float = 0.0) -> list[str]:
    """Delete all but the latest versions, those that are leased, and those that a newer one replaced less than min_age seconds ago; returns which
    went. A version that is to go is hidden first, so that nobody leases it any more; a prune that died in between is finished by the next."""
    found, now, gone = versions(spark, path), time.time_ns(), []
    fs, root = _fs(spark, path)
    sub = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    listed = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    going = [n for n in listed if n.startswith("v") and n not in found and fs.exists(sub(f"{n}/_going"))]
    held = leased(spark, path)
    for name, newer in zip(found[:-keep], found[1:]):
        if name not in held and now - int(newer[1:]) >= min_age * 1e9:
            fs.rename(sub(f"{name}/_done"), sub(f"{name}/_going"))
            going.append(name)
    held = leased(spark, path) if going else set()
    for name in going:
        if name in held:
            fs.rename(sub(f"{name}/_going"), sub(f"{name}/_done"))
        else:
            fs.delete(sub(name), True)
            gone.append(name)
    return gone
