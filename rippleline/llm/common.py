"""Helpers shared by the corpus operators: word pattern, batches of texts, keys of rows, files of their own formats."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.runtime import drop, fresh, materialize, shared_dir, table_path  # noqa: F401

#: A word is a run of anything but space and \t..\r (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of texts that go to Python are bounded by bytes, as texts may be long, not by rows alone. The same bound
    for all operators, in whatever order they run; one that a user has set stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, _BATCH_BYTES)


def release() -> None:
    """Give memory back to the system: Python workers live on, and what one task freed would count against the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def released(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in a text, null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


_SPACE = {bytes: re.compile(rb"[\x20\x09-\x0D]"), str: re.compile(r"[\x20\x09-\x0D]")}


def stretches(text: str | bytes, size: int = 1 << 20) -> Iterator[str | bytes]:
    """A long text in stretches that end before white space, so that no word is cut."""
    at = 0
    while at < len(text):
        cut = _SPACE[type(text)].search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def row_key(df: DataFrame) -> Column:
    """128 bits of hash of a whole row, as (a, b): rows with the same key are the same in every column."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]), {"ignoreNullFields": "false"})
    text = [F.col("text").isNull(), F.col("text")] if "text" in df.columns else []
    return F.struct(F.xxhash64(row, *text).alias("a"), F.xxhash64(F.lit("b"), *text, row).alias("b"))


def other_columns(df: DataFrame, made: Iterable[str]) -> tuple[list[Column], str]:
    """The columns of df that a result keeps beside those it makes, and a helper column's name that clashes with none. A column named as one
    that is made, in whatever case, gives way to it."""
    taken = {c.lower() for c in made}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], fresh([*df.columns, *made], "_found")


def keeping(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs that meet a condition on what `judged` makes of their text; all columns as they were, whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("_row")
    found = judged(docs.select(row, "text")).where(condition)
    return found.select(*[F.col("text") if c.lower() == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])


@contextmanager
def opened(path: str, mode: str):
    """A file of a store that tasks share, by its full path (a plain one, or file:, s3a:, s3:, gs:, hdfs: where its library is there): "rb" or "wb"."""
    path = re.sub("^s3[an]://", "s3://", path)  # Spark's names for what is s3: here
    path = re.sub("^file:/*", "/", path)  # as a path, whose signs aren't encoded
    store, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    if mode == "wb":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        with store.open_output_stream(at, compression=None) as f:
            yield f
    else:
        with store.open_input_file(at) as f:
            yield f
