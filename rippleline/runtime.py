"""Session helpers: the shared folder, tables written to it, and their removal."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one
    process may a temporary folder take its place."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rippleline-"))
    return sc.getCheckpointDir().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def materialize(df: DataFrame, name: str, observation: Observation | None = None, **counters: Column) -> DataFrame:
    """Write once to the shared folder and read back. The lineage ends there, every executor can read it, and its size is
    known to the planner, which then broadcasts it only if it is small. Once written, the table needs no shuffle
    files, so they go at once. An observation takes aggregates of the rows as they are written: no pass of their own, and counted in
    the job's last stage, where Spark takes each partition once, also if a task runs again."""
    spark = df.sparkSession
    path = table_path(spark, name)
    if observation is not None:
        df = df.observe(observation, *[c.alias(k) for k, c in counters.items()])
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rippleline_path = path  # type: ignore[attr-defined]
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """materialize() in buckets by a column, as many as there are shuffle partitions, sorted by it: joins on it don't move this side."""
    spark = df.sparkSession
    path, n = table_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = "rippleline_" + path.rpartition("/")[2].replace("-", "_")
    with setting(spark, _CLEANUP, "true"):
        df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._rippleline_path, out._rippleline_table = path, table  # type: ignore[attr-defined]
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by materialize() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_rippleline_path", None)
        if table := getattr(df, "_rippleline_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of these clashes with, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
