"""Incremental ingestion: new and changed source files as a stream.

A stream takes files as they appear. Each micro-batch writes its raw edges and the versions of its files under its batch id, so a batch
that runs again overwrites its own rows and nothing is counted twice. catch_up() compares the versions with what is there now, and takes
rewritten and deleted files; the version seen last replaces earlier ones, also where it has no edges any more.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rippleline.operators import messages
from rippleline.runtime import drop, materialize
from rippleline.schema import FILES
from rippleline.sources.files import in_skipped_dir, language, plain_path, qualified, text_of


def stream_files(spark: SparkSession, root: str, service: str, per_batch: int = 1000) -> DataFrame:
    """files below a root, as they come; content is null where it isn't UTF-8."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_batch).load(root).select(F.col("_metadata.file_path").alias("at"), F.col("modificationTime").alias("modified"), text_of(F.col("content")).alias("content"))
    )
    named = raw.withColumn("path", plain_path(F.try_url_decode(F.replace(F.col("at"), F.lit("+"), F.lit("%2B"))))).withColumn("lang", language(F.col("path"))).where(F.col("lang").isin(*messages.PATTERNS) & ~in_skipped_dir(F.col("at"), qualified(spark, root)))
    return named.select(F.lit(service).alias("service"), F.lit(0).alias("source_ord"), "path", "lang", "content", "modified")


def extract(files: DataFrame) -> DataFrame:
    """Raw topic and procedure edges of some files."""
    sites = messages.topic_sites(files)
    return messages.topic_edges(sites).unionByName(messages.invokes(files))


def _record(out: str, batch: str, edges: DataFrame, files: DataFrame, gone: bool = False) -> None:
    """Edges first, versions last: edges of a batch that failed in between aren't read. A batch that runs again overwrites its own rows."""
    edges.write.mode("overwrite").parquet(f"{out}/edges/batch={batch}")
    files.select("path", "modified", F.lit(time.time_ns()).alias("seen"), F.lit(gone).alias("gone")).write.mode("overwrite").parquet(f"{out}/files/batch={batch}")


def append_edges(out: str, operator: Callable[[DataFrame], DataFrame] = extract) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: the edges of a batch, and the versions of all its files, with edges or without."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _record(out, f"s{batch_id}", operator(batch.where("content is not null").drop("modified")), batch)

    return write


def start(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return files.writeStream.foreachBatch(append_edges(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_files(spark: SparkSession, out: str) -> DataFrame:
    """(path, modified, batch): the version of each file that was seen last, of files that weren't gone by then."""
    try:
        found = spark.read.schema("path string, modified timestamp, seen long, gone boolean, batch string").parquet(f"{out}/files")
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], "path string, modified timestamp, batch string")
    return found.groupBy("path").agg(F.max_by(F.struct("modified", "batch", "gone"), F.struct("seen", "batch")).alias("last")).where("not last.gone").select("path", "last.modified", "last.batch")


def current_edges(spark: SparkSession, out: str) -> DataFrame:
    """Edges of the last version of each file; a version without edges has none, and a file that is gone neither."""
    return spark.read.parquet(f"{out}/edges").withColumn("batch", F.col("batch").cast("string")).join(current_files(spark, out), ["path", "batch"], "left_semi").drop("batch")


def catch_up(spark: SparkSession, root: str, service: str, out: str, per_batch: int = 1000) -> tuple[int, int]:
    """Bring `out` up to date with files that were rewritten or deleted, which a file stream doesn't see (it knows files by their
    path), and with new ones: (how many were read, how many are gone). Emptied files count as gone, as Spark lists none without bytes. Listing opens no file; what changed is read `per_batch` files at a time."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    there = listed.select(F.col("_metadata.file_path").alias("at"), plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"))
    there = there.where(language(F.col("path")).isin(*messages.PATTERNS) & ~in_skipped_dir(F.col("at"), qualified(spark, root)))
    known = current_files(spark, out)
    gone = materialize(known.join(there, "path", "left_anti").select("path", "modified"), "gone")
    changed = materialize(there.join(known.select("path", "modified"), ["path", "modified"], "left_anti"), "changed")
    if n_gone := gone.count():
        _record(out, f"g{time.time_ns()}", extract(spark.createDataFrame([], FILES)), gone, True)
    n, rows = 0, changed.select("at").orderBy("at").toLocalIterator()
    while some := [r.at for r in itertools.islice(rows, per_batch)]:
        raw = listed.where(F.col("_metadata.file_path").isin(some)).select(plain_path(F.col("path")).alias("path"), F.col("modificationTime").alias("modified"), text_of(F.col("content")).alias("content"))
        batch = raw.select(F.lit(service).alias("service"), F.lit(0).alias("source_ord"), "path", language(F.col("path")).alias("lang"), "content", "modified")
        _record(out, f"c{time.time_ns()}", extract(batch.where("content is not null").drop("modified")), batch)
        n += len(some)
    drop(gone, changed)
    return n, n_gone
