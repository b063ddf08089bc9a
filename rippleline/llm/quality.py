"""Quality rules: base counts, then divergence from language references.

Each document's histogram over character classes and over a language's common words is compared to the
reference of that language by Jensen-Shannon distance (base 2, so from 0 to 1). References are sums over
all documents of a language; common words are its `common` most frequent. A document passes if
some language has both distances within limits. A guard for length loosens the limits by
`slack` / sqrt(words), as short texts stray by chance, and below `min_words` words or `min_chars` characters the
comparison isn't made at all.

Edge cases: null text has no words and fails the base rules; documents without lang don't add to references but
are judged like others, whatever their lang; with no reference at all the base rules decide;
repeated rows and ties are judged each; long texts are counted whole; an empty table gives an
empty result; other columns pass through unless a result has their name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleline.llm.common import bounded_batches, drop, keeping, materialize, other_columns, release, released, stretches

COMMON, SALTS = 60, 16
MAX_CHARS, MAX_WORDS, SLACK = 0.30, 0.455, 0.25
MIN_WORDS, MIN_CHARS = 50, 200
_FLUSH = 1 << 17

# What counts as white space and as a symbol.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond_ascii")


def _class_table() -> np.ndarray:
    """Byte to class; bytes that continue a character have a class of their own, which is dropped."""
    t = np.full(256, 6, np.int64)
    for name, chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, SPACE), (4, ".,;:!?'\"-()"), (5, SYMBOLS)):
        t[[ord(c) for c in chars]] = name
    t[0x80:0xC0] = 8
    t[0xC0:] = 7
    return t


_TABLE = _class_table()


_OF_CLASS = (_TABLE[:, None] == np.arange(8)).astype(np.int64)


def byte_counts(data: np.ndarray) -> np.ndarray:
    """How often each byte occurs; a long text goes in parts, as counting takes eight times what it counts."""
    return sum((np.bincount(data[at : at + (1 << 20)], minlength=256) for at in range(0, len(data), 1 << 20)), np.zeros(256, np.int64))


def classes(raw: bytes) -> np.ndarray:
    return byte_counts(np.frombuffer(raw, np.uint8)) @ _OF_CLASS


class Tokens:
    """Lower-case tokens of some texts, punctuation and white space between them: `which` of the `distinct` ones, and the `doc`
    of each; and the histogram of character classes of each text."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.string())
        low = pc.utf8_lower(texts)
        for c in PUNCTUATION:
            low = pc.replace_substring(low, c, " ")
        lists = pc.ascii_split_whitespace(low)
        coded = lists.flatten().dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        if "" in self.distinct:  # stands where a text begins or ends with white space
            real = which != self.distinct.index("")
            which, doc = which[real], doc[real]
        self.which, self.doc, self.n = which, doc, len(texts)
        raw = texts.cast(pa.binary())
        ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + self.n + 1].tolist()
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        self.chars = np.array([byte_counts(data[i:j]) for i, j in zip(ends, ends[1:])], np.int64).reshape(self.n, 256) @ _OF_CLASS


def _slices(array: pa.Array, rows: int = 500) -> Iterator[pa.Array]:
    for at in range(0, len(array), rows):
        yield array.slice(at, rows)


def numbered(raw: bytes) -> tuple[np.ndarray, int]:
    """The words of a text as numbers, and how many distinct ones there are; its words are in memory a stretch at a time.
    bytes.split() parts at the white space of the contract and nothing else."""
    number: dict[bytes, int] = {}
    parts = [np.zeros(0, np.int64)]
    for part in stretches(raw):
        words = part.split()
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    return np.concatenate(parts), len(number)


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    ids, distinct = numbered(text.encode("utf-8", "surrogatepass"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(ids), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), dup, repeated(ids, distinct)


def repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, pair = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    window = pair[:-1] * distinct + ids[2:]
    _, where, count = np.unique(window, return_inverse=True, return_counts=True)
    often = count[where] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= often
    return int(covered.sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of p to q."""
    p, q = np.atleast_2d(p) / np.maximum(np.atleast_2d(p).sum(1, keepdims=True), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.maximum(d / 2, 0))


def references(docs: DataFrame, common: int = COMMON) -> dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]]:
    """{lang: (class counts, {common word: place}, their counts and that of all others)}, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}

        def out():
            parts = [(lang, [""] * 8, range(8), c.tolist()) for lang, c in chars.items()] + [(lang, list(c), repeat(-1, len(c)), list(c.values())) for lang, c in words.items()]
            chars.clear()
            words.clear()
            for lang, w, k, n in parts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(w), pa.string()), pa.array(w, pa.string()), pa.array(k, pa.int32()), pa.array(n, pa.int64())], ["lang", "word", "class", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                t = Tokens(part.column(1))
                coded = part.column(0).dictionary_encode()
                of_doc, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                counts = np.bincount(of_doc[t.doc] * len(t.distinct) + t.which, minlength=len(names) * len(t.distinct)).reshape(len(names), -1)
                for i, lang in enumerate(names):
                    chars[lang] = chars.get(lang, 0) + t.chars[of_doc == i].sum(0)
                    here = np.flatnonzero(counts[i])
                    words.setdefault(lang, Counter()).update(dict(zip(map(t.distinct.__getitem__, here.tolist()), counts[i][here].tolist())))
                if sum(map(len, words.values())) > _FLUSH:
                    yield from out()
        yield from out()

    bounded_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    raw = known.select("lang", "text").mapInArrow(released(count), "lang string, word string, class int, n long")
    counts = materialize(raw.groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "quality-counts")
    totals = counts.groupBy("lang", "class").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("word"), F.lit(SALTS))).orderBy(F.desc("n"), "word")
    few = counts.where("class < 0").withColumn("r", F.row_number().over(within)).where(F.col("r") <= common)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= common)
    made: dict = {}
    for lang, c, n in totals.collect():
        one = made.setdefault(lang, (np.zeros(8), {}, [0.0]))
        if c < 0:
            one[2][0] = float(n)
        else:
            one[0][c] = n
    for lang, w, n in top.select("lang", "word", "n").orderBy("lang", F.desc("n"), "word").collect():
        _, place, sums = made[lang]
        place[w] = len(place)
        sums.append(float(n))
    drop(counts)
    return {lang: (c, place, np.array([*s[1:], s[0] - sum(s[1:])])) for lang, (c, place, s) in sorted(made.items())}


def distances(t: Tokens, refs: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(character distances, word distances) of the texts for each language."""
    for chars, place, sums in refs.values():
        k = len(place)
        at = np.fromiter(map(place.get, t.distinct, repeat(k)), np.int64, len(t.distinct))
        found = np.bincount(t.doc * (k + 1) + at[t.which], minlength=t.n * (k + 1)).reshape(t.n, k + 1)
        yield js_distance(t.chars, chars), js_distance(found, sums)


def verdicts(texts: pa.Array, n_words: np.ndarray, refs: dict, max_chars: float = MAX_CHARS, max_words: float = MAX_WORDS, slack: float = SLACK) -> np.ndarray:
    """Whether each text is near some language's reference, or too short to tell."""
    short = (n_words < MIN_WORDS) | (pc.utf8_length(texts.fill_null("")).to_numpy(zero_copy_only=False) < MIN_CHARS)
    if not refs:
        return np.ones(len(texts), bool)
    loose = slack / np.sqrt(np.maximum(n_words, 1))
    near = np.zeros(len(texts), bool)
    for c, w in distances(Tokens(texts), refs):
        near |= (c <= max_chars + loose) & (w <= max_words + loose)
    return near | short


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def assess(docs: DataFrame, refs: dict | None = None) -> DataFrame:
    """docs with the base counts, base_failed and kept."""
    bounded_batches(docs.sparkSession)
    refs = references(docs) if refs is None else refs
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
    def rules(texts: pa.Array) -> pa.Array:
        parts = []
        for some in _slices(texts):
            n = np.array([base(t.as_py()) for t in some], np.int64).reshape(-1, 5)
            failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
            kept = ~failed & verdicts(some, n[:, 0], shared.value)
            parts.append(pa.StructArray.from_arrays([*(pa.array(n[:, i]) for i in range(5)), pa.array(failed), pa.array(kept)], names=list(_FIELDS)))
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(f, pa.int64() if f[0] in "nw" else pa.bool_()) for f in _FIELDS]))

    keep, found = other_columns(docs, _FIELDS)
    return docs.select(*keep, rules(F.col("text")).alias(found)).select(*keep, *[f"{found}.{c}" for c in _FIELDS])


def keep_good(docs: DataFrame) -> DataFrame:
    refs = references(docs)
    return keeping(docs, lambda d: assess(d, refs), "kept")
