"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, linked components.

A fingerprint is cut in four blocks of 16 bits. Two fingerprints that differ in at most two
bits agree on at least two blocks, so each is filed under its six pairs of blocks, those
filed together are joined, and their Hamming distance is checked.

A crowded block pair (more than `crowd` fingerprints) isn't joined with itself, as its pairs
grow with its square. Its members go to balls instead: the fingerprint and the 64 that
differ in one bit. Two fingerprints are within two bits exactly if their balls meet, and all
whose balls meet in a point are within two bits of each other, so linking
each to the smallest in that point loses no link and makes 65 rows each. A point
lies in at most 65 balls, so no group is large.

Equal fingerprints are one class from the start. Components come from alternating star
contraction; labels are fingerprints until the end.

Edge cases: null and wordless texts have fingerprint 0 and are linked like any other;
rows with null doc_id take part and their component is the smallest doc_id in it, null if it has none;
repeated rows and ties are one class; rows that share a doc_id but not their text are rows of their own; other columns, whatever their
names, are kept by deduplicate() and not read by with_components(); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleline.llm.common import bounded_batches, drop, fresh, materialize, row_key, stretches

BITS, BLOCK, CROWD = 64, 16, 24
MAX_DISTANCE = 2  # blocks and balls are made for this


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint as an unsigned number. bytes.lower() and bytes.split() know ASCII only, as the contract asks. Words
    and hashes of one stretch of the text are in memory at a time."""
    counts, n, words = np.zeros(BITS, np.int64), 0, []
    for raw in stretches((text or "").encode("utf-8", "surrogatepass")):
        words += raw.lower().split()
        if len(words) < shingle:
            continue
        length = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(length + 1) - 1
        joined, start = b" ".join(words), end - length
        digest = xxhash.xxh64_intdigest
        last = len(words) - shingle + 1
        hashes = [digest(joined[i:j], seed) for i, j in zip(start[:last].tolist(), end[shingle - 1 :].tolist())]
        array = np.array(hashes, dtype="<u8")
        for at in range(0, last, 1 << 16):
            counts += np.unpackbits(array[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += last
        words = words[last:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def simhash_udf(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([simhash(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64))


def _blocks(fp: Column) -> Column:
    parts = [F.shiftrightunsigned(fp, BLOCK * i).bitwiseAND(F.lit((1 << BLOCK) - 1)) for i in range(BITS // BLOCK)]
    pairs = [F.shiftleft(parts[a], BLOCK).bitwiseOR(parts[b]) for a, b in combinations(range(len(parts)), 2)]
    return F.array(*[F.struct(F.lit(i).alias("pair"), p.alias("value")) for i, p in enumerate(pairs)])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """prints: distinct (fp). Returns (a, b), a > b, that connect all within two bits."""
    filed = prints.select("fp", F.explode(_blocks(F.col("fp"))).alias("at")).select("fp", "at.pair", "at.value")
    sizes = materialize(filed.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "blocks")
    filed = materialize(filed.join(sizes, ["pair", "value"]), "filed")
    drop(sizes)
    few = filed.where(F.col("n") <= crowd)
    near = (
        few.alias("x").join(few.alias("y"), ["pair", "value"])
        .where("x.fp > y.fp").where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_DISTANCE)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    crowded = filed.where(F.col("n") > crowd).select("fp").distinct()
    flips = [0, *(1 << i for i in range(BITS - 1)), -(1 << (BITS - 1))]
    ball = crowded.select("fp", F.explode(F.array(*[F.lit(f).cast("long") for f in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = ball.groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 by geometry
    star = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a > b")
    found = materialize(near.union(star).distinct(), "links")
    drop(filed)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root) for every node of an edge; root is the smallest of its
    component. Large-star and small-star in turn until nothing changes. Each step joins two
    written tables, so adaptive execution can split the rows of a hub."""
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    given = edges
    edges = materialize(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    drop(given)
    was = state(edges)
    while was[0]:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        lower = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        hooked = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = materialize(hooked.union(lower).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
        now = state(small)
        for t in (edges, least, large, lower):
            drop(t)
        edges = small
        if now == was:
            break
        was = now
    # Every edge now leads to a root; the root itself closes the list.
    return edges.toDF("node", "root").union(edges.select("b", "b").distinct())


def classes(prints: DataFrame, key: Column, crowd: int = CROWD) -> DataFrame:
    """prints: fp and what `key` is made of -> (fp, root, first): each fingerprint, the smallest one that links lead to, and
    its least key."""
    each = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    found = components(links(each.select("fp"), crowd))
    rooted = materialize(each.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    drop(each)
    return rooted


def with_components(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id)."""
    bounded_batches(docs.sparkSession)
    printed = materialize(docs.select(F.col("doc_id"), simhash_udf(F.col("text")).alias("fp")), "prints")
    rooted = classes(printed, F.col("doc_id"), crowd)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = materialize(rooted.join(ids, "root").select("fp", "component_id"), "named")
    drop(rooted)
    return printed.join(named, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id (null ids last), among equal ids that of the least
    fingerprint and then of the least hash of the row. Components are told apart by their root fingerprint, so rows that share an
    id and nothing else stay. Only keys and fingerprints are grouped; texts are read by a semi-join, once."""
    bounded_batches(docs.sparkSession)
    key = row_key(docs)
    printed = materialize(docs.select("doc_id", simhash_udf(F.col("text")).alias("fp"), key.alias("key")), "prints")
    rooted = classes(printed, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "key"))
    best = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select("first.key"), "kept")
    # A row that is there several times in every column is kept once: such keys are set apart, as others need no shuffle of rows.
    often = materialize(printed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(best, "key", "left_semi").select("key"), "often")
    drop(rooted, printed)
    name = fresh(docs.columns, "_key")
    keyed = docs.withColumn(name, key)
    once = keyed.join(best.join(often, "key", "left_anti").withColumnRenamed("key", name), name, "left_semi")
    repeated = keyed.join(often.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return once.select(*columns).union(repeated.select(*columns))
