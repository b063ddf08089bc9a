"""Files that tasks open themselves, in the stores that Spark reads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path (a plain one, or file:, s3a:, s3:, gs:, hdfs: where its library is there), and the path in it."""
    path = re.sub("^file:/*", "/", re.sub("^s3[an]://", "s3://", path))
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def write_files(files: DataFrame, root: str) -> int:
    """Write files(path, content) below a root that tasks share, and count them. A task that runs again writes the same bytes anew."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = located(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = f"{base}/{path}"
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at, compression=None) as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = files.selectExpr("path", "cast(content AS binary) AS content").mapInArrow(write, "n long")
    return rows.groupBy().sum("n").first()[0] or 0
