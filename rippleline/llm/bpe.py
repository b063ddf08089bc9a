"""BPE encoding and decoding over a table of distinct words.

For tokenizers that drop white space and never let a token span it: a text's ids are the ids of its
words in order. So words are split, each distinct word is encoded once by the
tokenizers library, and ids are joined back by position; decoding joins ids to their pieces.

The word table has two parts. The most frequent words, never more than `hot_words` of them, have ids that
every task gets. All other words are joined by shuffle: (document, position, word) to (word, ids). Hot words never take
part in that join, and what is left has no key with more than about 1 / hot_words of all words (see
hot_and_rare). Documents travel as word ranks, not as texts.

Words are normalised only where the library would do the same: texts of Latin-1 without
"<|" are lower-cased, and full stops and commas after a letter or digit, before white space,
become words of their own.

Edge cases: null and empty texts have no ids and decode to the empty text; documents
are told apart by doc_id and a hash of their text (see keyed), so repeated ids and rows (and null ids) are kept,
each with its result, and work on rare words grows with distinct documents, not copies; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleline.llm.common import bounded_batches, drop, materialize, released

HOT_WORDS = 1 << 18
_FLUSH = 1 << 18  # distinct words that a task counts before it hands on partial counts
_SLICE = 1000  # documents that a task works on at once
_MET = 1 << 18  # documents that a task remembers to have met
_CACHE: dict = {}
_ID = "<u2"  # as ids travel inside; wider vocabularies are refused

# Texts that stay as they are; stops after what they might form a token with; stops that part from a word.
_AS_IS = r"[^\x00-\x{ff}]|<\|"
_TIGHT = r"[^a-z0-9ß-öø-ÿ\x20\x09-\x0D][.,]"
_STOPS = r"([a-zß-öø-ÿ])([.,]+)([\x20\x09-\x0D])"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what a task holds is bounded by them."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


class Words:
    """The words of some texts: `which` of the `distinct` ones, text after text; text i begins at bounds[i]. Empty words may
    stand at the ends of a text."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("")
        as_is = pc.match_substring_regex(texts, _AS_IS)
        low = pc.binary_join_element_wise(pc.utf8_lower(texts), "", " ")
        tight = pc.match_substring_regex(low, _TIGHT)
        plain = low
        for old, new in ((", ", " , "), (". ", " . "), (",\n", " ,\n"), (".\n", " .\n")):
            plain = pc.replace_substring(plain, old, new)
        if pc.any(tight).as_py():
            plain = pc.if_else(tight, pc.replace_substring_regex(pc.if_else(tight, low, ""), _STOPS, r"\1 \2\3"), plain)
        lists = pc.ascii_split_whitespace(pc.if_else(as_is, texts, plain))
        self.bounds = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        self.which = coded.indices.to_numpy()
        self.dictionary = coded.dictionary.cast(pa.binary())
        self.distinct: list[bytes] = self.dictionary.to_numpy(zero_copy_only=False).tolist()


def _groups(bounds: np.ndarray, words: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Runs of documents of about so many words: temporary arrays have a place for each bit."""
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + words, "right")) - 1)
        yield i, j
        i = j


def pack(ranks: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A blob a document: its number of words, the compressed bit lengths of rank + 3, and what follows their leading bits."""
    made: list[bytes] = []
    for a, b in _groups(bounds):
        v, at = ranks[bounds[a] : bounds[b]] + np.int32(3), bounds[a : b + 1] - bounds[a]
        lengths = (np.frexp(v.astype(np.float32))[1] - 1).astype(np.uint8)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)]).astype(np.int32)
        per = ends[at[1:]] - ends[at[:-1]]
        first = np.concatenate([[0], np.cumsum(-(-per // 8))]).astype(np.int32)
        bit = np.arange(ends[-1], dtype=np.int32)
        out = np.zeros(first[-1] * 8, bool)
        out[bit + np.repeat(first[:-1] * 8 - ends[at[:-1]], per)] = np.repeat(v, lengths) >> (bit - np.repeat(ends[:-1], lengths)) & 1
        rest = np.packbits(out, bitorder="little").tobytes()
        for i in range(b - a):
            z = pa.compress(lengths[at[i] : at[i + 1]].tobytes(), "zstd", asbytes=True)
            made.append(int(at[i + 1] - at[i]).to_bytes(4, "little") + len(z).to_bytes(4, "little") + z + rest[first[i] : first[i + 1]])
    return made


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, bounds) of pack()."""
    n = [int.from_bytes(x[:4], "little") for x in blobs]
    bounds = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int64)
    ranks = np.empty(bounds[-1], np.int32)
    for a, b in _groups(bounds):
        cut = [8 + int.from_bytes(x[4:8], "little") for x in blobs[a:b]]
        lengths = np.frombuffer(b"".join([pa.decompress(x[8:z], k, "zstd", asbytes=True) for x, z, k in zip(blobs[a:b], cut, n[a:b]) if k]), np.uint8)
        if not len(lengths):
            continue
        rest = [x[z:] for x, z in zip(blobs[a:b], cut)]
        at = bounds[a : b + 1] - bounds[a]
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)]).astype(np.int32)
        first = np.concatenate([[0], np.cumsum([len(x) for x in rest])]).astype(np.int32)
        bit = np.arange(ends[-1], dtype=np.int32)
        one = np.unpackbits(np.frombuffer(b"".join(rest), np.uint8), bitorder="little")[bit + np.repeat(first[:-1] * 8 - ends[at[:-1]], ends[at[1:]] - ends[at[:-1]])]
        value = np.add.reduceat(one.astype(np.int32) << (bit - np.repeat(ends[:-1], lengths)), ends[:-1])
        ranks[bounds[a] : bounds[b]] = value + (np.int32(1) << lengths.astype(np.int32)) - 3
    return ranks, bounds


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of flat, one after another."""
    return flat.take(np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()))


def split_words(text: str | None) -> list[bytes]:
    """The words of one text."""
    w = Words(pa.array([text], pa.string()))
    return [w.distinct[i] for i in w.which if w.distinct[i]]


def tokenizer(definition: str):
    """The library's tokenizer for a definition, once a process, without truncation and padding."""
    key = ("tokenizer", hashlib.md5(definition.encode()).digest())
    if key not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(definition)
        made.no_truncation()
        made.no_padding()
        _CACHE[key] = made
    return _CACHE[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts; tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return rows

        for batch in _slices(batches):
            w = Words(batch.column(0))
            seen.update(dict(zip(w.distinct, np.bincount(w.which, minlength=len(w.distinct)).tolist())))
            if len(seen) > _FLUSH:
                yield out()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(released(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, definition) -> DataFrame:
    """(word, n) -> (word, n, ids): each distinct word is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(definition.value)
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = t.encode_batch_fast([w.decode() for w in names], add_special_tokens=False)
            ids = pa.array([np.array(e.ids, _ID).tobytes() for e in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(released(encode), "word binary, n long, ids binary")


_EXACT, _OCTAVE = 1 << 12, 64


def _bin(n: Column) -> Column:
    """Counts below _EXACT are bins of their own; above, an octave has _OCTAVE bins."""
    return F.when(n < _EXACT, n.cast("int")).otherwise((_EXACT + F.floor((F.log2(n.cast("double")) - float(_EXACT.bit_length() - 1)) * _OCTAVE)).cast("int"))


def hot_and_rare(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(word, n, ...) in two parts: the most frequent words, never more than `most` of them whatever the counts, and all others.

    Bins of counts are taken from the top while their words fit. The histogram has fewer than _EXACT + 52 * _OCTAVE rows. The first
    bin that doesn't fit holds, with those above it, more than `most` words, so no word in it or below has more
    than about 1 / most of all words: what is left to the join by shuffle has no hot key."""
    bins = words.groupBy(_bin(F.col("n")).alias("c")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).collect()
    total, least = 0, None
    for c, k in bins:
        total += k
        if total > most:
            break
        least = c
    if least is None:
        return words.where(F.lit(False)), words
    hot = _bin(F.col("n")) >= least
    return words.where(hot), words.where(~hot)


def pieces(definition: str) -> list[str]:
    """The id-to-piece table: one entry an id."""
    t = tokenizer(definition)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def tag(text: Column) -> Column:
    """What tells texts of one id apart at first: 29 bits of a hash; the lowest two are left for marks."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFC).cast("long")).cast("int")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, d, h, text): documents with the same d and h have the same text, and the same id or none.

    d is the id, or where it is null a hash of the text, and h its tag. Where texts of one id share their tag, which a pass over hashes finds, d is a
    64-bit hash of id and text instead. A null id and such a d are marked in h, so none is taken for an id."""
    text = F.coalesce("text", F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({
        "d": F.coalesce("doc_id", F.xxhash64(F.lit("d"), text)), "h": tag(text).bitwiseOR(F.col("doc_id").isNull().cast("int")),
    })
    other = F.xxhash64(F.lit("u"), text)
    shared = materialize(given.select("d", "h", other.alias("u")).groupBy("d", "h").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).where("lo < hi").select("d", "h", F.lit(True).alias("shared")), "shared-tags")
    if shared.isEmpty():
        drop(shared)
        return given.select("doc_id", "d", "h", "text")
    found = given.join(shared, ["d", "h"], "left")
    return found.select("doc_id", F.when(F.col("shared"), F.xxhash64("d", "h", other)).otherwise(F.col("d")).alias("d"), F.when(F.col("shared"), F.col("h").bitwiseOR(2)).otherwise(F.col("h")).alias("h"), "text")


def _assembled(docs: DataFrame, path: str, hot_words: int, finish: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """(doc_id, text) -> what `finish` makes of the doc_ids of some documents, their ids and where each one's begin."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    if tokenizer(definition.value).get_vocab_size(with_added_tokens=True) > 1 << 16:
        raise ValueError("vocabularies of more than 65,536 ids are not supported")
    table = materialize(encode_words(word_counts(docs), definition), "words")
    top, others = hot_and_rare(table, hot_words)
    hot = top.orderBy(F.desc("n"), "word").select("word", "ids").toArrow()  # at most hot_words rows
    # Compact as they are sent; a task makes what it needs of them and drops it, so workers don't grow from query to query.
    hot_names = spark.sparkContext.broadcast(_flat(hot.column(0).to_pylist(), np.uint8))
    hot_ids = spark.sparkContext.broadcast(_flat(hot.column(1).to_pylist(), _ID))

    def ranker() -> Callable[[Words], np.ndarray]:
        sizes, flat = hot_names.value
        raw, ends = flat.tobytes(), np.cumsum(sizes).tolist()
        get = {raw[i:j]: r for r, (i, j) in enumerate(zip([0, *ends], ends))}.get
        return lambda w: np.fromiter(map(get, w.distinct, repeat(-1)), np.int32, len(w.distinct))[w.which]

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked, met = ranker(), set()
        for batch in _slices(batches):
            d, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # A document that was met before adds nothing; copies in other tasks go when places are grouped.
            new = [i for i, key in enumerate(zip(d.tolist(), h.tolist())) if key not in met and not met.add(key)]
            if len(met) > _MET:
                met.clear()
            d, h = d[new], h[new]
            w = Words(batch.column(2).take(pa.array(new, pa.int64())))
            at = np.flatnonzero(ranked(w) < 0)
            doc = np.searchsorted(w.bounds, at, "right") - 1
            words = w.dictionary.take(pa.array(w.which[at]))
            place = h[doc].astype(np.int64) << 32 | (at - w.bounds[doc])
            yield pa.RecordBatch.from_arrays([pa.array(d[doc]), pa.array(place), words], ["d", "place", "word"])

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = ranker()
        for batch in _slices(batches):
            w = Words(batch.column(3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pack(ranked(w), w.bounds), pa.binary())], ["doc_id", "d", "h", "ranks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, flat = hot_ids.value
        starts = np.cumsum(sizes) - sizes
        for batch in _slices(batches):
            ranks, bounds = unpack(batch.column(1).to_pylist())
            n = np.zeros(len(ranks), np.int64)
            at = np.zeros(len(ranks), np.int64)
            known = np.flatnonzero(ranks >= 0)
            n[known], at[known] = sizes[ranks[known]], starts[ranks[known]]
            rest = batch.column(2)
            doc = np.repeat(np.arange(len(rest)), rest.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            more = rest.flatten()
            own, extra = _flat(more.field("ids").to_pylist(), _ID)
            where = bounds[doc] + (more.field("place").to_numpy() & 0xFFFFFFFF)
            n[where], at[where] = own, len(flat) + np.cumsum(own) - own
            ids = gather(np.concatenate([flat, extra]), at, n)
            yield finish(batch.column(0), ids, np.concatenate([[0], np.cumsum(n)])[bounds])

    texts = keyed(docs)
    found = texts.select("d", "h", "text").mapInArrow(released(rare), "d long, place long, word binary").join(others.select("word", "ids"), "word")
    h = F.shiftright("place", 32).cast("int")
    # Each place of a document once, however often the document is there; no shuffle in between.
    places = found.select("d", "place", "ids").repartition("d", h).groupBy("d", h.alias("h"), "place").agg(F.first("ids").alias("ids"))
    by_doc = places.groupBy("d", "h").agg(F.collect_list(F.struct("place", "ids")).alias("rest"))
    known = texts.mapInArrow(released(common), "doc_id long, d long, h int, ranks binary")
    return known.join(by_doc, ["d", "h"], "left").select("doc_id", "ranks", "rest").mapInArrow(released(merge), schema)


def _flat(parts: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
    """(how many each has, all)."""
    return np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize, np.frombuffer(b"".join(parts), kind)


def encode(docs: DataFrame, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids binary): ids as little-endian unsigned 32-bit numbers."""

    def finish(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        wide = ids.astype("<u4")
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([wide[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary())], ["doc_id", "ids"])

    return _assembled(docs, path, hot_words, finish, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, decoded), by an id-to-piece join. The piece table is one row an id of
    the vocabulary, so it is bounded and goes to every task."""
    spark = encoded.sparkSession
    with open(path, encoding="utf-8") as f:
        piece = spark.sparkContext.broadcast(pieces(f.read()))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = piece.value.__getitem__
        for batch in batches:
            texts = [" ".join(map(at, np.frombuffer(x, "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(released(join), "doc_id long, ids binary, decoded string")


def digest(docs: DataFrame, path: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """The round trip as digests a document: ids are decoded by the id-to-piece join where they are put together, so
    neither they nor the texts leave the task."""
    with open(path, encoding="utf-8") as f:
        piece = docs.sparkSession.sparkContext.broadcast(pieces(f.read()))

    def finish(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        at, wide, hashes, texts = piece.value.__getitem__, ids.astype("<u4"), [], []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            hashes.append(hashlib.sha256(wide[i:j]).hexdigest())
            texts.append(hashlib.sha256(" ".join(map(at, ids[i:j].tolist())).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(bounds)), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _assembled(docs, path, hot_words, finish, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
