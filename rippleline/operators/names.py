"""An index of names, written once for each version of a graph: looking a symbol up, or what comes closest to it, without reading all names.

`spelled` has the nodes by full key and by bare name, `keys` each key once, `postings` (term, key) for each token and trigram of a key, `terms` how many keys
a term has and how often one of them repeats it. All compare in upper case and are sorted by what they are looked up by, over files and
small row groups, so that a look-up reads a few of those. A term of many keys is spread over files.

`suggest` equals a score of every key. It takes keys from the sources that a score may come from: keys inside the query, keys around it (the rarest of its
trigrams), keys that share a token, rarest token first, and keys that begin alike, longest beginning first. A source gives its best few with their full score.
Keys that no source has given yet are bounded by what the sources that are left could add; when the worst of the best few is above that, it stops.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rippleline.functions.text import LOWER, UPPER, ascii_upper, similarity, tokens
from rippleline.runtime import setting
from rippleline.schema import node_key

PREFIX = 6  # how much of a common beginning counts
GRAM = 3
#: Parts of a query that are looked up one by one; of a longer query, keys are read to see which it holds.
PARTS = 2_000
_END = "\0" * (GRAM - 1)  # after a key, so that a short query is the beginning of a trigram wherever it stands
_LAYOUT = {"parquet.block.size": 1 << 20, "parquet.page.row.count.limit": 100}
#: Values that a filter on a file compares one by one; of more it would take the range.
_ONE_BY_ONE, _SOME = "spark.sql.parquet.pushdown.inFilterThreshold", 200


@dataclass(frozen=True)
class Names:
    spelled: DataFrame
    keys: DataFrame
    postings: DataFrame
    terms: DataFrame


def _gram_terms(up: Column) -> Column:
    padded = F.concat(up, F.lit(_END))
    return F.transform(F.sequence(F.lit(1), F.length(up)), lambda i: F.concat(F.lit("g"), F.substr(padded, i, F.lit(GRAM))))


def write(nodes: DataFrame, path: str) -> None:
    """Write the index of nodes(id, name, schema, ...) below a path. A key is cut up as it is read; no row holds more than one key's terms."""
    spark = nodes.sparkSession

    def sorted_out(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.options(**_LAYOUT).parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    key, name = ascii_upper(node_key()), ascii_upper(F.col("name"))
    ways = F.array(F.struct(key.alias("up"), F.lit(0).alias("rank")), F.struct(name.alias("up"), F.lit(1).alias("rank")))
    spelled = nodes.select(F.explode(F.when(name.isNull() | (key == name), F.slice(ways, 1, 1)).otherwise(ways)).alias("_way"), F.struct(*nodes.columns).alias("node"))
    sorted_out(spelled.select("_way.up", "_way.rank", "node"), "spelled", "up", "rank")
    keys = sorted_out(nodes.select(node_key().alias("key")).distinct().select("key", ascii_upper(F.col("key")).alias("up")), "keys", "up", "key")
    said = tokens(F.col("key"))
    told = F.transform(F.array_distinct(said), lambda t: F.struct(F.concat(F.lit("t"), t).alias("term"), F.size(F.filter(said, lambda x: x == t)).alias("times")))
    grams = F.transform(F.array_distinct(_gram_terms(F.col("up"))), lambda g: F.struct(g.alias("term"), F.lit(1).alias("times")))
    postings = sorted_out(keys.select(F.explode(F.when(F.length("up") > 0, F.concat(told, grams)).otherwise(told)).alias("_t"), "key").select("_t.term", "key", "_t.times"), "postings", "term", "key")
    sorted_out(postings.groupBy("term").agg(F.count(F.lit(1)).alias("keys"), F.max("times").alias("most")), "terms", "term")


def read(spark: SparkSession, path: str) -> Names:
    return Names(*[spark.read.parquet(f"{path}/{name}") for name in ("spelled", "keys", "postings", "terms")])


def find(names: Names, query: str) -> DataFrame:
    """The node with this full key, or else with this name, case aside; the smallest id. At most one row."""
    found = names.spelled.where(F.col("up") == F.lit(_upper(query)))
    return found.orderBy("rank", "node.id").limit(1).select("node.*")


def _upper(query: str) -> str:
    return query.translate(str.maketrans(LOWER, UPPER))


class _Best:
    """The best keys so far."""

    def __init__(self, query: str, limit: int):
        self.query, self.limit, self.found = query, limit, {}

    def take(self, keys: DataFrame) -> None:
        """The best of (key): a top-k, of which a task hands on no more than the limit."""
        scored = keys.select("key", similarity(F.col("key"), F.lit(self.query)).cast("int").alias("score")).where("score > 0")
        with setting(keys.sparkSession, _ONE_BY_ONE, str(_SOME)):
            self.found |= {r.key: r.score for r in scored.orderBy(F.desc("score"), "key").limit(self.limit).collect()}

    def rows(self) -> list[tuple[str, int]]:
        return sorted(self.found.items(), key=lambda x: (-x[1], x[0]))[: self.limit]

    def above(self, bound: int) -> bool:
        """Whether no other key can come in, if its score is at most the bound."""
        return bound <= 0 or (len(self.found) >= self.limit and (self.limit == 0 or self.rows()[-1][1] > bound))


def _chunks(values: list[str]) -> list[list[str]]:
    return [values[i : i + _SOME] for i in range(0, len(values), _SOME)]


def _known(names: Names, terms: list[str]) -> dict[str, Row]:
    """What is known of some terms."""
    with setting(names.terms.sparkSession, _ONE_BY_ONE, str(_SOME)):
        return {r.term: r for some in _chunks(terms) for r in names.terms.where(F.col("term").isin(some)).collect()}


def suggest(names: Names, query: str, limit: int) -> list[tuple[str, int]]:
    """(key, score) of the most similar keys, best first; ties by key."""
    q, best = _upper(query), _Best(query, limit)
    if not q:
        best.take(names.keys)  # each key holds it
        return best.rows()
    wanted = sorted({t for t in re.split("[^A-Z0-9]+", q) if t})
    grams = {"g" + q[i : i + GRAM] for i in range(len(q) - GRAM + 1)}
    terms = _known(names, [*("t" + t for t in wanted), *sorted(grams)])
    parts = {q[i:j] for i in range(len(q)) for j in range(i + 1, len(q) + 1)} if len(q) * (len(q) + 1) // 2 <= PARTS else set()
    if parts:
        for some in _chunks(["", *sorted(parts)]):
            best.take(names.keys.where(F.col("up").isin(some)))
    else:
        best.take(names.keys.where(F.contains(F.lit(q), F.col("up"))))
    if not grams:
        around = names.postings.where(F.col("term").startswith("g" + q)).select("key").distinct()
        best.take(around)
    elif all(g in terms for g in grams):
        rarest = min(grams, key=lambda g: (terms[g].keys, g))
        best.take(names.postings.where((F.col("term") == rarest) & F.contains(ascii_upper(F.col("key")), F.lit(q))))
    # What is left neither holds the query nor is held by it.
    rare_first = sorted((r for t in wanted if (r := terms.get("t" + t))), key=lambda r: (r.keys, r.term))
    for i, row in enumerate(rare_first):
        if best.above(4 * sum(r.most for r in rare_first[i:]) + min(PREFIX, len(q))):
            return best.rows()
        best.take(names.postings.where(F.col("term") == row.term))
    for n in range(min(PREFIX, len(q)), 0, -1):
        if best.above(n):
            break
        best.take(names.keys.where(F.col("up").startswith(q[:n])))
    return best.rows()


def suggestions(names: Names, queries: list[str], limit: int) -> DataFrame:
    """(query, key, score) of a few queries."""
    spark = names.keys.sparkSession
    made = [spark.createDataFrame([(q, k, s) for k, s in suggest(names, q, limit)], "query string, key string, score int") for q in queries]
    return functools.reduce(DataFrame.union, made) if made else spark.createDataFrame([], "query string, key string, score int")
