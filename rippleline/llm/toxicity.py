"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over words; each model also sees the
probabilities of the categories before it. For fitting, those are out-of-fold predictions, so
a later model learns from what an earlier one says of documents it hasn't seen.

Categories are label columns, in the order of the chain: by default low quality (quality = 0), then
toxic. Models are fitted on at most `fit_docs` labelled documents, chosen by hash, over at most
FEATURES words and beginnings of words (of those in LEAST documents or more that stray TELLING standard deviations from a category's base rate, the
farthest); all
documents are then predicted from their whole texts.

Edge cases: null and empty texts get the probability of no words; labels that are null, and documents
with several labels, count as their smallest label; of several texts of one id one is learned from; without labels all probabilities are 0; documents with null
doc_id are predicted but not learned from; repeated rows are each predicted; an
empty table gives an empty result; other columns pass through unless a result has their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleline.llm.common import bounded_batches, drop, materialize, other_columns
from rippleline.llm.langid import is_held_out

FIT_DOCS, FEATURES, LEAST, TELLING, FOLDS, SALTS = 8000, 20000, 4, 4.0, 5, 16
ROUNDS, L2 = 150, 1e-4
PREFIXES, TIMES = (4, 5, 6, 7), 3
_WORD = re.compile(r"[^\W\d_]+")
CATEGORIES = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))


def features(text: str | None) -> set[str]:
    """Of a whole text: its lower-case words, and the beginnings of words, with a + for each time up to TIMES: insults are
    inflected, and what is chance once isn't so three times."""
    found = Counter(_WORD.findall((text or "").lower()))
    starts: dict[str, int] = {}
    for w, n in found.items():
        for k in PREFIXES:
            if len(w) >= k:
                p = w[:k]
                starts[p] = starts.get(p, 0) + n
    out = set(found)
    for p, n in starts.items():
        p += "+"
        out.add(p)
        for _ in range(min(n, TIMES) - 1):
            p += "+"
            out.add(p)
    return out


class Linear:
    """Logistic regression over word presence and the probabilities of earlier categories."""

    def __init__(self, size: int, earlier: int):
        self.w, self.dense, self.bias = np.zeros(size), np.zeros(earlier), 0.0

    def score(self, doc: np.ndarray, word: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(doc, self.w[word], minlength=n) + earlier @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, doc: np.ndarray, word: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
        """Adam on the whole sample; starts from the base rate."""
        n, size = len(y), len(self.w)
        self.bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        theta = np.concatenate([self.w, self.dense, [self.bias]])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for t in range(1, ROUNDS + 1):
            self.w, self.dense, self.bias = theta[:size], theta[size:-1], theta[-1]
            r = (self.score(doc, word, n, earlier) - y) / n
            g = np.concatenate([np.bincount(word, r[doc], minlength=size), earlier.T @ r, [r.sum()]])
            g[:-1] += L2 * theta[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.w, self.dense, self.bias = theta[:size], theta[size:-1], float(theta[-1])
        return self


def chain(doc: np.ndarray, word: np.ndarray, size: int, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model a column of labels; later ones are fitted on out-of-fold predictions of earlier ones."""
    n, made = len(labels), []
    earlier = np.zeros((n, 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        made.append(Linear(size, c).fit(doc, word, earlier, y))
        if c + 1 < labels.shape[1]:
            out = np.zeros(n)
            for f in range(FOLDS):
                inside, test = fold != f, fold == f
                place = np.cumsum(inside) - 1
                rows = inside[doc]
                model = Linear(size, c).fit(place[doc[rows]], word[rows], earlier[inside], y[inside])
                out[test] = model.score(doc, word, n, earlier)[test]
            earlier = np.column_stack([earlier, out])
    return made


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[tuple[str, str]] = CATEGORIES, fit_docs: int = FIT_DOCS, most: int = FEATURES) -> tuple[list[str], list[Linear]]:
    """The words and the chain's models."""
    bounded_batches(docs.sparkSession)
    made = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", *[F.coalesce(F.expr(e).cast("int"), F.lit(0)).alias(f"y{i}") for i, (_, e) in enumerate(categories)])
    made = made.groupBy("doc_id").agg(*[F.min(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    h = F.xxhash64("doc_id")
    bucket = Window.partitionBy(F.pmod(F.shiftright(h, 40), F.lit(SALTS))).orderBy(h, "doc_id")
    picked = made.withColumn("r", F.row_number().over(bucket)).where(F.col("r") <= max(1, fit_docs // SALTS)).drop("r")

    @F.pandas_udf("array<string>")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features(t)))

    # At most fit_docs rows of ids and labels: bounded whatever the data.
    ys = [f"y{i}" for i in range(len(categories))]
    one = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # Of several texts of one id the least hash's is taken; a task keeps one of them before the shuffle.
    one = one.select("doc_id", *ys, tokens("text").alias("words"), F.xxhash64("text").alias("h")).groupBy("doc_id").agg(F.min_by(F.struct(*ys, "words"), "h").alias("x"))
    sample = materialize(one.select("doc_id", "x.*"), "labelled")
    rates = sample.agg(F.count(F.lit(1)), *[F.avg(y) for y in ys]).first()
    if not rates[0]:
        return [], []
    counts = sample.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys])
    # How far the word's documents stray from the base rate of a category, in standard deviations.
    telling = F.greatest(F.lit(0.0), *[F.abs(F.col(y) - F.col("n") * float(p)) / F.sqrt(F.col("n") * max(float(p) * (1 - float(p)), 1e-9)) for y, p in zip(ys, rates[1:])])
    top = counts.where((F.col("n") >= LEAST) & (telling >= TELLING)).orderBy(telling.desc(), F.desc("n"), "word").limit(most)
    vocabulary = sorted(r[0] for r in top.select("word").collect())
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    @F.pandas_udf("array<int>")
    def places(rows: pd.Series) -> pd.Series:
        known = shared.value
        return rows.map(lambda ws: [known[w] for w in ws if w in known])

    rows = sample.select("doc_id", *ys, places("words").alias("at")).toPandas().sort_values("doc_id")
    drop(sample)
    lengths = rows["at"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(rows)), lengths)
    word = np.concatenate(rows["at"].tolist()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    fold = np.random.default_rng(0).integers(0, FOLDS, len(rows))
    return vocabulary, chain(doc, word, len(vocabulary), rows[ys].to_numpy(), fold)


def predict(docs: DataFrame, model: tuple[list[str], list[Linear]], categories: Sequence[tuple[str, str]] = CATEGORIES) -> DataFrame:
    """docs with p_<category> for each category, and toxic_pred: the last category's verdict."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(model[0])}, model[1]))
    names = [f"p_{c}" for c, _ in categories]

    @F.pandas_udf(", ".join(f"{x} double" for x in names))
    def probabilities(texts: pd.Series) -> pd.DataFrame:
        known, models = shared.value
        at = [sorted(known[w] for w in features(t) & known.keys()) for t in texts] if models else []
        doc = np.repeat(np.arange(len(at)), [len(x) for x in at]).astype(np.int64)
        word = np.fromiter((i for x in at for i in x), np.int64)
        found = np.zeros((len(texts), 0))
        for m in models:
            found = np.column_stack([found, m.score(doc, word, len(texts), found)])
        return pd.DataFrame(found if models else np.zeros((len(texts), len(names))), columns=names)

    keep, found = other_columns(docs, (*names, "toxic_pred"))
    out = docs.select(*keep, probabilities(F.col("text")).alias(found)).select(*keep, *[f"{found}.{c}" for c in names])
    return out.withColumn("toxic_pred", F.col(names[-1]) >= 0.5)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
