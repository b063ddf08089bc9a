"""Source trees as a data source that prunes the descent: `spark.read.format("source_tree")`.

Folders that hold no code of one's own are neither listed nor opened, nor are those that a filter on the path rules out. The plan lists
folders from the root on only until there are `fan` of them to go down into; they are dealt to as many partitions at most, whose tasks walk what is below. The options `languages`
and `prefix` say what is wanted; with the option `filters`, filters on `lang` and on how `path` begins are taken over too, which Spark allows only where
spark.sql.python.filterPushdown.enabled is set.

As a stream, a batch has the files that were modified since the last one, so also those that were rewritten; it lists them in tasks and keeps
nothing but a time. Files count as settled after `settle` seconds (10): a file that shows up later than that after its time of modification, or is given an older
time, isn't seen, and neither are files that go; catch_up() finds these.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from rippleline.sources.files import EXTENSIONS, SKIP_DIRS, text_of
from rippleline.sources.shared import located

SCHEMA = "path string, lang string, modified_ms long, length long, content binary"
_ARROW = pa.schema([("path", pa.string()), ("lang", pa.string()), ("modified_ms", pa.int64()), ("length", pa.int64()), ("content", pa.binary())])
#: A batch ends at so many files or bytes.
FILES_A_BATCH, BYTES_A_BATCH = 1000, 32 << 20


@dataclass
class Wanted:
    """What is asked of a tree. Paths are given as the root is, without file: in front."""

    root: str
    languages: tuple[str, ...]
    prefix: str = ""
    after_ms: int | None = None
    until_ms: int | None = None
    base: str = field(init=False)

    def __post_init__(self):
        self.root = re.sub("^file:/*", "/", self.root).rstrip("/")
        self.base = located(self.root)[1].rstrip("/")

    def shown(self, at: str) -> str:
        return self.root + at[len(self.base) :]

    def enters(self, folder: str) -> bool:
        shown = self.shown(folder) + "/"
        return folder.rpartition("/")[2] not in SKIP_DIRS and (shown.startswith(self.prefix) or self.prefix.startswith(shown))

    def language(self, info: pyarrow.fs.FileInfo) -> str | None:
        """Of a file that is wanted, else None. As in Spark's listings, names that begin with a dot or an underscore and files without bytes aren't."""
        name = info.base_name
        lang = EXTENSIONS.get(name.rpartition(".")[2]) if "." in name else None
        if lang not in self.languages or name[0] in "._" or not info.size or not self.shown(info.path).startswith(self.prefix):
            return None
        at = info.mtime_ns // 1_000_000
        return None if self.after_ms is not None and at <= self.after_ms or self.until_ms is not None and at > self.until_ms else lang


def listed(store: pyarrow.fs.FileSystem, folder: str, wanted: Wanted) -> tuple[list[str], list[tuple[pyarrow.fs.FileInfo, str]]]:
    """The folders in a folder that are to be entered, and its files that are wanted with their language, in order of name. A link to a folder is
    a folder; one that leads to itself is not followed by more than the store allows."""
    found = sorted(store.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path)
    folders = [i.path for i in found if i.type == pyarrow.fs.FileType.Directory and wanted.enters(i.path)]
    files = [(i, lang) for i in found if i.type == pyarrow.fs.FileType.File and (lang := wanted.language(i)) is not None]
    return folders, files


def walk(store: pyarrow.fs.FileSystem, folder: str, wanted: Wanted, deep: bool = True) -> Iterator[tuple[pyarrow.fs.FileInfo, str]]:
    """Wanted files of a folder and, where deep, of all below it. Only folders still to be listed are held."""
    left = [folder]
    while left:
        folders, files = listed(store, left.pop(), wanted)
        yield from files
        if deep:
            left += reversed(folders)


def starts(store: pyarrow.fs.FileSystem, wanted: Wanted, fan: int) -> list[tuple[str, bool]]:
    """(folder, deep): where to walk from, so that each folder is walked once. Levels are listed until they have `fan` folders or end."""
    level, out = [wanted.base], []
    while level and len(level) < fan:
        out += [(f, False) for f in level]
        level = [x for f in level for x in listed(store, f, wanted)[0]]
    return out + [(f, True) for f in level]


class Piece(InputPartition):
    def __init__(self, folders: list[tuple[str, bool]], wanted: Wanted):
        self.folders, self.wanted = folders, wanted


def pieces(wanted: Wanted, fan: int) -> list[Piece]:
    """Where to walk from, dealt to `fan` tasks at most: a level may have any number of folders, and a task costs more than a small one."""
    fan = max(fan, 1)
    found = starts(located(wanted.root)[0], wanted, fan)
    return [Piece(found[i::fan], wanted) for i in range(min(fan, len(found)))]


def _read(piece: Piece) -> Iterator[pa.RecordBatch]:
    store, _ = located(piece.wanted.root)
    rows, size = [], 0
    for info, lang in (x for folder, deep in piece.folders for x in walk(store, folder, piece.wanted, deep)):
        try:
            with store.open_input_file(info.path) as f:
                content = f.read()
        except FileNotFoundError:  # it went since it was listed
            continue
        rows.append((piece.wanted.shown(info.path), lang, info.mtime_ns // 1_000_000, len(content), content))
        size += len(content)
        if len(rows) >= FILES_A_BATCH or size >= BYTES_A_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _wanted(options: dict) -> Wanted:
    return Wanted(options["path"], tuple(x for x in options.get("languages", "go,rust,cpp").split(",") if x), options.get("prefix", ""))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.wanted, self.fan = _wanted(options), int(options.get("fan", "256"))

    def partitions(self) -> list[Piece]:
        return pieces(self.wanted, self.fan)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class FilteringReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("lang",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.languages = tuple(x for x in self.wanted.languages if x in asked)
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",) and f.value.startswith(self.wanted.prefix):
                self.wanted.prefix = f.value
            else:
                yield f


class TreeStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.fan, self.settle = dict(options), int(options.get("fan", "256")), float(options.get("settle", "10"))

    def initialOffset(self) -> dict:
        return {"until_ms": -1}

    def latestOffset(self) -> dict:
        return {"until_ms": int((time.time() - self.settle) * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        wanted = _wanted(self.options)
        wanted.after_ms, wanted.until_ms = start["until_ms"], end["until_ms"]
        return pieces(wanted, self.fan)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """Options: path (the root), languages (go,rust,cpp), prefix (of paths), fan (256), filters (false); as a stream also settle (10)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteringReader if self.options.get("filters", "false").lower() == "true" else TreeReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


def pruned_tree(spark: SparkSession, root: str, service: str, source_ord: int = 0, languages: tuple[str, ...] = ("go", "rust", "cpp")) -> DataFrame:
    """scan_tree() by this source: the same files, of a store that pyarrow reads too."""
    spark.dataSource.register(SourceTree)
    raw = spark.read.format("source_tree").option("languages", ",".join(languages)).load(root)
    return raw.select(F.lit(service).alias("service"), F.lit(source_ord).alias("source_ord"), "path", "lang", text_of(F.col("content")).alias("content"))


def pruned_stream(spark: SparkSession, root: str, service: str, settle: float = 10.0) -> DataFrame:
    """Files as stream_files() has them, and those that are rewritten."""
    spark.dataSource.register(SourceTree)
    raw = spark.readStream.format("source_tree").option("settle", str(settle)).load(root)
    return raw.select(F.lit(service).alias("service"), F.lit(0).alias("source_ord"), "path", "lang", text_of(F.col("content")).alias("content"), F.timestamp_millis("modified_ms").alias("modified"))
