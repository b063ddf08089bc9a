"""Language identification by rank-order profiles of character n-grams.

A language's profile is its `profile` most frequent 1- to 3-grams of letters (word ends count as
a space), counted over at most `fit_docs` labelled documents a language, chosen by hash. A document's own
most frequent n-grams are compared to each profile by out-of-place distance: the difference of ranks,
or `profile` where the language lacks the n-gram. The least distance wins; the score is one less
the distance as a share of the greatest possible.

Only text decides. The lang column is read to fit, from documents whose crc32(doc_id as text)
modulo `folds` isn't `held_out`. Profiles are bounded: `profile` rows a language.

Edge cases: null texts and texts without a letter are `und` with score 0, as is everything where
nothing can be learned; ties go to the first language by name; rows with null doc_id are
predicted (held_out null) but not learned from; repeated rows are each predicted; very long texts are counted
whole, in stretches; an empty table gives an empty result; other columns pass through unless a result has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleline.llm.common import bounded_batches, keeping, other_columns, released, stretches

PROFILE, FIT_DOCS, DOC_SALTS, SALTS = 300, 3200, 64, 16
MIN_SCORE = 0.1
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if it's a letter, else a space."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64))
    return _LETTERS[0]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same codes together."""
    codes, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.concatenate([[32], _letters()[points], [32]])
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    letter = c != 32
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.unique(np.concatenate([c[letter], two, three[letter[1:-1]]]) if len(c) > 2 else np.zeros(0, np.int64), return_counts=True)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text, packed in 21 bits a letter, and their counts. A long text is counted in stretches: both
    sides of a cut end in a space, as the text does there."""
    total = None
    for part in stretches(text or "", 1 << 18):
        found = _grams(part)
        total = found if total is None else _sum([total, found])
    return total or (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(text: str | None, profile: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by code."""
    codes, counts = grams(text)
    if len(codes) > profile:
        least = np.partition(counts, -profile)[-profile]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")][:profile]


def is_held_out(doc_id: Column, folds: int = 4, held_out: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == held_out


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, profile: int = PROFILE, fit_docs: int = FIT_DOCS) -> dict[str, np.ndarray]:
    """{language: its n-grams in rank order}."""
    bounded_batches(docs.sparkSession)
    pool = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"), folds, held_out))
    pool = pool.select("doc_id", "lang", "text", F.xxhash64("text").alias("th"))
    h = F.xxhash64("doc_id")
    picked = pool.select("doc_id", "lang", "th", h.alias("h"), F.pmod(F.shiftright(h, 40), F.lit(DOC_SALTS)).alias("salt"))
    first = Window.partitionBy("lang", "salt").orderBy("h", "doc_id", "th")
    picked = picked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max(1, fit_docs // DOC_SALTS)).select("doc_id", "lang", "th").distinct()
    # At most fit_docs rows a language: bounded whatever the data. A row that is there several times is learned once.
    sample = pool.join(F.broadcast(picked), ["doc_id", "lang", "th"], "left_semi").groupBy("doc_id", "lang", "th").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(lang, []).append(grams(text.as_py()))
            for lang, found in by.items():
                codes, n = _sum(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.select("lang", "text").mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(F.desc("n"), "gram")
    few = counts.withColumn("r", F.row_number().over(within)).where(F.col("r") <= profile)
    over = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = few.withColumn("r", F.row_number().over(over)).where(F.col("r") <= profile).select("lang", "r", "gram").collect()
    return {lang: np.array([g for _, g in sorted((r, g) for x, r, g in rows if x == lang)], np.int64) for lang in sorted({x[0] for x in rows})}


def classifier(profiles: dict[str, np.ndarray], profile: int = PROFILE):
    """Text to (language, score), for one text."""
    tables = [(lang, np.sort(codes), np.argsort(codes, kind="stable")) for lang, codes in sorted(profiles.items())]

    def classify(text: str | None) -> tuple[str, float]:
        mine = ranked(text, profile)
        if not len(mine) or not tables:
            return "und", 0.0
        at = np.arange(len(mine))
        best = None
        for lang, codes, ranks in tables:
            i = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            d = int(np.where(codes[i] == mine, np.minimum(np.abs(ranks[i] - at), profile), profile).sum())
            if best is None or d < best[1]:
                best = lang, d
        return best[0], 1.0 - best[1] / (profile * len(mine))

    return classify


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """docs with lang_pred and score. Text alone is read."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, score double")
    def classify(texts: pa.Array) -> pa.Array:
        one = classifier(shared.value, profile)
        found = [one(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang_pred", "score"])

    keep, found = other_columns(docs, ("lang_pred", "score"))
    return docs.select(*keep, classify(F.col("text")).alias(found)).select(*keep, f"{found}.lang_pred", f"{found}.score")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the documents that aren't held out, and predict all."""
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language can be told: a prediction, at a score that no mere noise reaches."""
    profiles = fit(docs)
    return keeping(docs, lambda d: predict(d, profiles), f"lang_pred <> 'und' AND score >= {min_score}")
