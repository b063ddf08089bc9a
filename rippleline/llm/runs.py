"""Periodic runs of words: maximal stretches with a smallest period, and texts with the repeats taken out.

A run of period p contains a Lyndon word of length p, and that word is the longest Lyndon word that starts there, in one of two orders
of the alphabet: the given one or its reverse (shorter suffixes come first in both). So the Lyndon array of each order lists a root of
every run. It is computed from right to left as the next smaller suffix of each position, along the chain of those already known:
two suffixes of that chain are told apart by extensions that were matched before, so a comparison goes on where an
earlier one ended. Matches at one distance are kept as the leftmost stretch that is known to match, and no pair of positions
is compared twice. A root is then extended to the left until words differ. Words are numbered by first appearance, which is all the order
that is needed; there is no suffix array, suffix tree or fingerprint.

Edge cases: null, empty and wordless texts have no words, no runs, and null or an empty text in return; a text of any length is one row, with memory
in proportion to its own words; repeated rows and ids are rows of their own; other columns, whatever
their names, are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleline.llm.common import bounded_batches, other_columns, release, stretches

MIN_LENGTH = 12
RUN = "array<struct<start: long, length: long, period: long>>"


def numbered(raw: bytes) -> tuple[list[int], list[bytes]]:
    """The words of a text as numbers by first appearance, and the words; cut at ASCII white space a stretch at a time."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for part in stretches(raw):
        ids.extend([number.setdefault(w, len(number)) for w in part.split()])
    return ids, list(number)


def lyndon_array(v: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller (v's length if none), and how far the two agree."""
    n = len(v)
    smaller, agree = [n] * n, [0] * n
    left, right = [n] * (n + 1), [n] * (n + 1)  # of each distance: the leftmost stretch known to match, which ends with a mismatch
    for i in range(n - 2, -1, -1):
        j, k, x = i + 1, 0, v[i]
        while True:
            if k or v[j] == x:  # they agree so far: go on
                d = j - i
                at, known, end = i + k, left[d], n - d
                while at < end and v[at] == v[at + d]:
                    at += 1
                    if at == known:
                        at = right[d]
                        break
                left[d], right[d], k = i, at, at - i
            if j + k == n or v[j + k] < v[i + k]:
                break
            # The suffix of j is larger; those after it on the chain are smaller than it.
            a, j = agree[j], smaller[j]
            while j < n and a > k:
                a, j = agree[j], smaller[j]
            if j == n:
                k = 0
                break
            if a < k:
                k = a
                break
        smaller[i], agree[i] = j, k
    return smaller, agree


def runs(v: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least min_length and twice their period, by start, then period."""
    found: set[tuple[int, int, int]] = set()
    for u in (v, [-x for x in v]):
        smaller, agree = lyndon_array(u)
        # The first root of a run agrees with what follows it in a word at least, as the run is twice as long.
        done: dict[int, int] = {}
        for i in np.flatnonzero(np.array(agree, np.int64)).tolist():
            p, end = smaller[i] - i, i + agree[i]
            floor = done.get(p, 0)
            if i < floor:
                continue
            done[p], start = end, i
            while start > floor and v[start - 1] == v[start - 1 + p]:
                start -= 1
            if end - start >= p and end - start + p >= min_length:
                found.add((start, end - start + p, p))
    return sorted(found)


def collapsed(ids: list[int], words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not found:
        return b" ".join(map(words.__getitem__, ids))
    gone = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return b" ".join([words[ids[i]] for i in keep])


def annotate(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with the columns runs (start, length and period of each, by word number) and collapsed (the text without repeats)."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(f"runs {RUN}, collapsed string")
    def find(texts: pa.Array) -> pa.Array:
        every, text = [], []
        for t in texts:
            if not t.is_valid:
                every.append([])
                text.append(None)
                continue
            ids, words = numbered(t.as_py().encode("utf-8", "surrogatepass"))
            found = runs(ids, min_length)
            every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            text.append(collapsed(ids, words, found).decode("utf-8", "surrogatepass"))
        release()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(every, kind), pa.array(text, pa.string())], names=["runs", "collapsed"])

    keep, found = other_columns(docs, ("runs", "collapsed"))
    return docs.select(*keep, find(F.col("text")).alias(found)).select(*keep, f"{found}.runs", f"{found}.collapsed")


def summary(found: Column) -> list[Column]:
    """n_runs, and start, length, period and exponent (in thousandths) of the longest run: the first, if several are as long."""
    first = F.array_min(F.transform(found, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return [
        F.size(found).cast("long").alias("n_runs"), first["s"].alias("start"), (-first["l"]).alias("length"), first["p"].alias("period"),
        F.floor(-first["l"] * 1000 / first["p"]).cast("long").alias("exponent_milli"),
    ]


@F.arrow_udf(T.StringType())
def planted(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    """Texts whose words from a place on repeat with a period, both drawn from the seed: what the registered query looks for besides."""
    out = []
    for t, seed in zip(texts, seeds):
        if not t.is_valid or not seed.is_valid:
            out.append(None)
            continue
        words, g = t.as_py().encode("utf-8", "surrogatepass").split(), seed.as_py() // 10
        n = len(words)
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words[a:] = (words[a : a + p] * ((n - a) // p + 1))[: n - a]
        out.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    return pa.array(out, pa.string())


def digest(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): the longest run, and digests of all runs and of the collapsed text. Documents whose id's
    crc32 ends in 0 are searched with a repeat planted into them."""
    bounded_batches(docs.sparkSession)
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(seed % 10 == 0, F.col("text"))
    found = annotate(docs.select("doc_id", F.coalesce(planted(chosen, seed), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    every = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", *summary(F.col("runs")), F.sha2(every, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
