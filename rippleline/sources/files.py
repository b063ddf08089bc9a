"""Source trees as a table of files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no code of one's own, and languages by extension (case matters).
SKIP_DIRS = (".git", "vendor", "node_modules", "target", "build", "third_party", ".idea")
EXTENSIONS = {"go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "h": "cpp", "sql": "sql"}


def language(path: Column) -> Column:
    by_extension = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return by_extension[F.regexp_extract(path, r"\.([^./]+)$", 1)]


def _parts(path: str | Column):
    """Components of a path without scheme and slashes in front."""
    if isinstance(path, str):
        return [x for x in re.sub(_SCHEME, "", path).split("/") if x]
    return F.filter(F.split(F.regexp_replace(path, _SCHEME, ""), "/"), lambda x: x != "")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


def qualified(spark: SparkSession, root: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def in_skipped_dir(path: Column, root: str) -> Column:
    """Whether a folder below the root is one of those. The path is the whole of it, with its scheme, as the root is."""
    parts, depth = _parts(path), len(_parts(root))
    return F.exists(F.slice(parts, depth + 1, F.greatest(F.size(parts) - 1 - depth, F.lit(0))), lambda d: d.isin(*SKIP_DIRS))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*", "/")


def text_of(content: Column) -> Column:
    """The text of a file's bytes, null where they aren't UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def scan_tree(spark: SparkSession, root: str, service: str, source_ord: int = 0, languages: tuple[str, ...] = ("go", "rust", "cpp")) -> DataFrame:
    """files(service, source_ord, path, lang, content) below a root; content is null where it isn't UTF-8. Other extensions
    go at the listing, and files in skipped folders before they are opened: the filter is on the file's path, which the scan knows."""
    globs = ",".join(e for e, lang in EXTENSIONS.items() if lang in languages)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + globs + "}").load(root)
    named = raw.where(~in_skipped_dir(F.col("_metadata.file_path"), qualified(spark, root))).select(plain_path(F.col("path")).alias("path"), "content")
    return named.select(F.lit(service).alias("service"), F.lit(source_ord).alias("source_ord"), "path", language(F.col("path")).alias("lang"), text_of(F.col("content")).alias("content"))


def unreadable(scanned: DataFrame) -> DataFrame:
    """(service, unreadable): how many files of each service aren't UTF-8."""
    return scanned.groupBy("service").agg(F.count_if(F.col("content").isNull()).alias("unreadable"))


def read_tree(spark: SparkSession, root: str, service: str, source_ord: int = 0, languages: tuple[str, ...] = ("go", "rust", "cpp"), strict: bool = False, scan: Callable[..., DataFrame] = scan_tree) -> DataFrame:
    """A scan without files that aren't UTF-8; where strict they fail the read."""
    text = scan(spark, root, service, source_ord, languages)
    if strict:
        return text.withColumn("content", F.coalesce("content", F.raise_error(F.concat(F.lit("not UTF-8: "), "path")).cast("string")))
    return text.where("content is not null")
