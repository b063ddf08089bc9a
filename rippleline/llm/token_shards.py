"""Token-id shards: documents in ascending doc_id order, a wavelet matrix a shard.

Documents are range-partitioned by doc_id; a task encodes its run and closes a shard when
it holds `shard_tokens` ids, give or take a batch, so memory doesn't follow the data. A shard is a file of its own (see wavelet) in the
shared folder, under a name that has its partition, its number and the attempt of its task; a manifest (partition, k, base,
tokens, path), which Spark commits, says which files count. So retries, speculation and lost executors leave files that nothing reads,
and no file is ever written over.

The library encodes each distinct stretch of text once per process: a text without adjacent white space is
cut before its spaces and new lines, where byte-level BPE with its own pattern always has a token
boundary, and before stops and commas that follow a letter or digit. Other texts, and those that may hold a special token, are encoded as they are.

Edge cases: null text is empty, and an empty document is just the end id; null doc_ids
come first, equal doc_ids are in the order of a hash of their texts, so that a hot one spreads over tasks; repeated rows are each
written; a document is never split over shards, however long; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleline.llm.bpe import tokenizer
from rippleline.llm.common import bounded_batches, materialize, opened, released, table_path
from rippleline.llm.wavelet import Wavelet, build

SHARD_TOKENS = 1 << 21
# Texts that aren't cut; stops that could form a token with what is before them; marks a stretch without a space before.
_APART = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}|<\||\x01"
_TIGHT = r"[^\p{L}\p{N}][.,]"
_BARE = "\x01"
_SPACE = re.compile(r"\s")
_KNOWN, _ENTRY = 300 << 20, 200  # bytes of stretches that a process remembers, and what each takes besides its text and ids
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")  # always a boundary of tokens


class Encoder:
    """Texts to ids. Arrow splits a batch of texts and finds its distinct stretches; those that were met before come from
    memory, which outlives a task, and the library encodes the others, many at a time."""

    def __init__(self, definition: str, wide: str):
        self.library, self.wide = tokenizer(definition), np.dtype(wide)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.wide).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_long(self, text: str, size: int = 1 << 18) -> bytes:
        """A text of any length, in portions: what the library returns takes some hundred bytes a token."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + size)
            end = cut.start() if cut else len(text)
            out += self._encode([text[at:end]])
            at = end
        return b"".join(out)

    def _remember(self, parts: list[str], ids: list[bytes]) -> None:
        self.known.update(zip(parts, ids))
        self.held += sum(map(len, parts)) + sum(map(len, ids)) + _ENTRY * len(parts)

    def _learn(self, parts: list[str]) -> None:
        """Encode stretches, many in one text with new lines between, as a new line is always a token of its own there.
        Those that hold white space go one by one."""
        plain = [p for p in parts if p and p[0] != _BARE and not _SPACE.search(p)]
        mark = np.frombuffer(self._encode(["\n"])[0], self.wide)
        # One text at a time: what the library returns takes some hundred bytes a token.
        for some in [plain[i : i + 4096] for i in range(0, len(plain), 4096)] if len(mark) == 1 else []:
            raw = self._encode([" " + "\n ".join(some)])[0]
            ids = np.frombuffer(raw, self.wide)
            ends = [*(np.flatnonzero(ids == mark[0]) * ids.itemsize).tolist(), len(raw)]
            if len(ends) == len(some):
                starts = [0, *(x + ids.itemsize for x in ends[:-1])]
                self._remember(some, [raw[i:j] for i, j in zip(starts, ends)])
        rest = [p for p in parts if p not in self.known]
        for some in [rest[i : i + 4096] for i in range(0, len(rest), 4096)]:
            self._remember(some, self._encode([p if p[:1] == "\n" else p[1:] if p[:1] == _BARE else " " + p for p in some]))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has)."""
        if not len(texts):
            return np.zeros(0, self.wide), np.zeros(0, np.int64)
        texts = texts.fill_null("")
        apart = pc.match_substring_regex(texts, _APART)
        marked = pc.replace_substring(pc.if_else(apart, "", texts), "\n", " \n")
        stops = marked
        for stop in (", ", ". "):  # not followed by white space only: the last one of a text stays where it is
            stops = pc.replace_substring(stops, stop, f" {_BARE}{stop}")
        lists = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, _TIGHT), marked, stops), " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        pieces = lists.flatten()
        # What a text begins with has no space before it; texts that aren't cut are all beginning.
        whole = pc.if_else(apart, texts, pieces.take(pa.array(first))).to_pylist()
        begin = [self._encode_long(x) for x in whole]
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > _KNOWN:
            self.known.clear()
            self.held = 0
        got = list(map(self.known.get, distinct))
        if None in got:
            self._learn([p for p, x in zip(distinct, got) if x is None])
            got = list(map(self.known.get, distinct))
        sizes = np.fromiter(map(len, (*got, *begin)), np.int64, len(got) + len(begin)) // self.wide.itemsize
        starts = np.cumsum(sizes) - sizes
        ids = np.frombuffer(b"".join((*got, *begin)), self.wide)
        which = coded.indices.to_numpy().copy()
        which[first] = len(got) + np.arange(len(first), dtype=which.dtype)
        n = sizes[which]
        at = np.repeat((starts[which] - (np.cumsum(n) - n)).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        return ids.take(at), np.add.reduceat(n, first)


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder(definition: str, wide: str) -> Encoder:
    """One a process."""
    key = (hash(definition), wide)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(definition, wide)
    return _ENCODERS[key]


_MANIFEST = "part int, k int, base long, tokens long, path string"


def write(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, out: str | None = None) -> DataFrame:
    """Encode, and write files below `out` (by default a new folder in the shared one); the manifest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = out or table_path(spark, "token-shards")
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    size = max(tokenizer(definition.value).get_vocab_size(with_added_tokens=True), end_id + 1)
    bits = (size - 1).bit_length()
    wide = "<u2" if bits <= 16 else "<u4"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, task = encoder(definition.value, wide), TaskContext.get()
        k = base = held = 0
        ids: list = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            name = f"{folder}/shard-{task.partitionId():06d}-{k:06d}-{task.taskAttemptId()}.rlwm"
            with opened(name, "wb") as f:
                f.write(build(np.concatenate(parts), ids, np.concatenate(lengths), bits))
            return pa.RecordBatch.from_pylist([{"part": task.partitionId(), "k": k, "base": base, "tokens": held, "path": name}], _SCHEMA)

        for batch in batches:
            got, n = texts.batch(batch.column(1))
            ids += batch.column(0).to_pylist()
            parts.append(np.insert(got, np.cumsum(n), end_id))
            lengths.append(n + 1)
            held += len(parts[-1])
            if held >= shard_tokens:
                yield close()
                k, base, held = k + 1, base + held, 0
                ids, parts, lengths = [], [], []
        if ids:
            yield close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("n"))
    ordered = keyed.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n").select("doc_id", "text")
    return materialize(ordered.mapInArrow(released(shards), _MANIFEST), "token-manifest")


_SCHEMA = pa.schema([("part", pa.int32()), ("k", pa.int32()), ("base", pa.int64()), ("tokens", pa.int64()), ("path", pa.string())])


def _documents(shards: DataFrame, finish: Callable[[memoryview], object], kind: str) -> DataFrame:
    """(doc_id, start, n_tokens, value) from the files of a manifest; value is made of a document's ids. Only one row a
    partition takes part in the running sum of starts."""
    runs = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with Wavelet.open(path) as w:
                    raw = memoryview(w.tokens()).cast("B")
                    ids, lengths = pa.array(w.doc_ids, pa.int64(), mask=w.doc_null), w.lengths
                ends = np.cumsum(lengths)
                at = ends - lengths
                starts_at = pa.array(at + first)
                for i in range(0, len(at), 2048):
                    made = [finish(raw[4 * x : 4 * y]) for x, y in zip(at[i : i + 2048].tolist(), ends[i : i + 2048].tolist())]
                    value = pa.array(made, pa.int64() if kind == "long" else pa.binary())
                    yield pa.RecordBatch.from_arrays([ids[i : i + 2048], starts_at[i : i + 2048], pa.array(lengths[i : i + 2048]), value], ["doc_id", "start", "n_tokens", "value"])

    # One row a partition of the write: bounded by the number of partitions, whatever the data.
    placed = shards.join(F.broadcast(starts), "part").select((F.col("first") + F.col("base")).alias("first"), "path")
    # The manifest is small and the files aren't: they are dealt out by number.
    dealt = placed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(released(documents), f"doc_id long, start long, n_tokens long, value {kind}")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary)."""
    return _documents(shards, bytes, "binary").withColumnRenamed("value", "ids")


def digest(docs: DataFrame, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write, read back, and reduce each document's ids to their crc32 where they are read."""
    return _documents(write(docs, path, end_id, shard_tokens), zlib.crc32, "long").withColumnRenamed("value", "ids_crc32")
