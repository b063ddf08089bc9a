"""Mixing sources to target weights by systematic sampling (native).

Each source has a target size: its share by weight of the total size, at most `cap` times
its own size, the excess reshared by weight. A document of the source is expected
target / source_size times. The expected copies are prefix-summed within the source, one
random offset is added, and a document is emitted once for each integer that its
stretch of the running sum crosses.

Documents are put in order of size class, salt and size, so that the sample is spread
evenly over sizes and taken words stay near the target. The prefix sum has two levels: rank in a
(source, class, salt) bucket, and running counts over the buckets of a source. There are as many salts as
keep a bucket near BUCKET_ROWS rows if all documents were of one source and class, so a hot source is
dealt over all tasks at any size.

Edge cases: null text counts as size 0; a null source is a source of its own, after all
others; a source of size 0 gets target 0; ties and repeated rows are separate
documents, and which of them is taken doesn't depend on the order of rows; an empty table gives an empty result;
mix() replaces input columns that are named like result columns, sample() keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleline.llm.common import drop, fresh, materialize, n_words, row_key

SALTS, BUCKET_ROWS, PORTION = 64, 1 << 20, 1024
RESULT = ("size", "source_size", "target", "copies", "taken")


def md5_int(value: Column, digits: int) -> Column:
    """The first hex digits of the md5 of a string, as a number: any SQL engine can repeat it."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("long")


def text_tie(text: Column) -> Column:
    return md5_int(F.coalesce(text, F.lit("")), 15)


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(skey, source, source_size) -> the same with target. Waterfilling in closed form: in
    order of size / weight the first sources are at their cap, and the rest divide what
    remains by weight. All sums are whole numbers, so the result is exact up to one division.
    One row per source: the windows without partitions see only those."""
    by_source = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(by_source) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * cap)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = (
        ranked.withColumn("total", F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("open"))
    )
    # The level is set by the first source that stays within its cap.
    level = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "skey", "left", "open"))).over(whole)
    return rest.withColumn("level", level).select(
        "skey", "source", "source_size",
        F.when(F.col("fits"), F.col("level.left") * F.col("weight") / F.col("level.open")).otherwise(F.col("cap").cast("double")).cast("double").alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 42, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken. One row per document. Equal sizes and doc_ids are in order of
    `tie`, by default 60 bits of the text's md5."""
    size = n_words(F.col("text")) if size is None else size
    tie = text_tie(F.col("text")) if tie is None else tie
    salts = max(SALTS, -(-docs.count() // BUCKET_ROWS))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    skey = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    base = docs.select(row.alias("row"), skey.alias("skey"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), size.alias("size"), tie.alias("tie"))
    base = base.withColumns({
        "class": F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int"),
        "salt": (md5_int(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("tie").cast("string")), 8) % salts).cast("int"),
    })
    bucket = ["skey", "class", "salt"]
    counts = base.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source", ignorenulls=True).alias("source"))
    sizes = counts.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    by_bucket = Window.partitionBy("skey").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*bucket, F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("start"))
    offset = md5_int(F.concat(F.lit(f"{seed}:"), F.col("skey")), 12) / F.lit(float(16**12))
    plan = starts.join(targets(sizes, weights, cap).drop("source"), "skey").select(
        *bucket, "start", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), offset.alias("u")
    )
    ranked = base.withColumn("k", F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "doc_id", "tie")))
    k = F.col("start") + F.col("k")
    crossed = (F.floor(k * F.col("rate") + F.col("u")) - F.floor((k - 1) * F.col("rate") + F.col("u"))).cast("int")
    out = ranked.join(plan, bucket).withColumn("copies", F.least(crossed, F.lit(cap)))
    made = {c.lower() for c in RESULT}
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return out.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def sample(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 42) -> DataFrame:
    """Each row of docs as many times as the mix takes it, with all its columns. Only keys, ids, sources and sizes are
    ranked; the number of copies goes back to the rows by a join on the key of the whole row. Rows that are the same in
    every column are taken together."""
    key = row_key(docs)
    narrow = materialize(docs.select(key.alias("key"), "doc_id", "source", n_words(F.col("text")).alias("n")), "sized")
    mixed = mix(narrow, weights, cap, seed, F.col("n"), F.col("key.a")).groupBy("key").agg(F.sum("copies").cast("int").alias("c"), F.count(F.lit(1)).alias("rows"))
    taken = materialize(mixed.where("c > 0"), "taken")
    often = materialize(taken.where("rows > 1"), "often")
    drop(narrow)
    name, times, copy = fresh(docs.columns, "_key"), fresh(docs.columns, "_c"), fresh(docs.columns, "_copy")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(name, key)
    joined = lambda some: keyed.join(some.select(F.col("key").alias(name), F.col("c").alias(times)), name)
    # Copies of repeated rows are dealt out in portions, as there may be any number of them.
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / PORTION).cast("int")), lambda i: F.least(F.lit(PORTION), F.col(times) - i * PORTION))
    many = joined(often).dropDuplicates([name]).select(*columns, F.explode(parts).alias(times)).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = joined(taken.where("rows = 1")).select(*columns, times).union(many)
    return both.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col(times))).alias(copy)).select(*columns)
