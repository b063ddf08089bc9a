"""The index of names against a score of every name, and what it reads."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from rippleline.operators import lookup, names


def score(key, query):
    up = lambda s: re.sub("[a-z]", lambda m: m[0].upper(), s)
    k, q = up(key), up(query)
    parts = lambda s: [t for t in re.split("[^A-Z0-9]+", s) if t]
    same = 0
    while same < min(len(k), len(q), 6) and k[same] == q[same]:
        same += 1
    return 4 * sum(t in parts(q) for t in parts(k)) + (3 if k in q or q in k else 0) + same


def nearest(keys, query, limit):
    found = [(k, score(k, query)) for k in set(keys)]
    return sorted((x for x in found if x[1] > 0), key=lambda x: (-x[1], x[0]))[:limit]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abAB1é", k=rng.randint(1, 4)))
    rows = [(i, "".join(word() + rng.choice(["_", ".", "", "-"]) for _ in range(rng.randint(1, 4))), rng.choice([None, None, "S", "app"])) for i in range(400)]
    rows += [(400, "", None), (401, "a_a_a_a", None), (402, "x", "a_b"), (403, "x", "A_B"), (404, "a", "b"), (405, "b.a", None), (406, "𝒳y", None), (407, None, None), (408, None, "only"), (409, "ab", None), (410, "ab", None)]
    nodes = spark.createDataFrame([(*r, "Topic", None) for r in rows], "id long, name string, schema string, kind string, chunk long")
    path = str(tmp_path_factory.mktemp("names") / "index")
    names.write(nodes, path)
    return nodes, names.read(spark, path), [".".join(x for x in (s, n) if x is not None) for _, n, s in rows]


@pytest.mark.parametrize("query", ["", "é", "AB_", "app.ab", "b1_a", "aaaa", "𝒳", "zz", "a a a", "x" * 70 + "ab", "_", "B.A"])
def test_suggest_as_by_all(small, query):
    _, index, keys = small
    assert names.suggest(index, query, 5) == nearest(keys, query, 5)


def test_suggest_limits(small):
    nodes, index, keys = small
    for limit in (0, 1, 1000):
        assert names.suggest(index, "ab", limit) == nearest(keys, "ab", limit)
    assert names.suggest(index, "app.ab", 5) == [tuple(r) for r in lookup.suggest(nodes, "app.ab", 5).collect()]


@pytest.mark.parametrize("query", ["x", "A_b.X", "AB", "b.a", "a", "", "none", "only", "𝒳Y"])
def test_find_as_by_all(small, query):
    nodes, index, _ = small
    assert names.find(index, query).collect() == lookup.find(nodes, query).collect()


def test_empty(spark, tmp_path):
    names.write(spark.createDataFrame([], "id long, name string, schema string, kind string, chunk long"), f"{tmp_path}/none")
    index = names.read(spark, f"{tmp_path}/none")
    assert names.find(index, "a").isEmpty() and names.suggest(index, "abc", 5) == []


def test_reads_little(spark, tmp_path, monkeypatch):
    """Names with common and rare tokens: a look-up reads a page of 100 rows for each of some thirty terms, however many names there are."""
    n = 50_000
    tail = F.substring(F.md5(F.col("id").cast("string")), 1, 8)
    nodes = spark.range(n).select("id", F.concat(F.lit("get_"), tail, F.lit("_by"), (F.col("id") % 5000).cast("string")).alias("name"), F.lit("app").alias("schema"), F.lit("Procedure").alias("kind"), F.lit(None).cast("long").alias("chunk"))
    names.write(nodes, f"{tmp_path}/many")
    index = names.read(spark, f"{tmp_path}/many")
    read, collect = [], DataFrame.collect

    def counted(self):
        out = collect(self)
        leaves = self._jdf.queryExecution().executedPlan().collectLeaves()
        read.extend(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    some = nodes.where("id = 77").select("name").first()[0]
    for query in (f"app.{some}x_by77", f"app.{some[:-1]}", "by4321"):
        read.clear()
        got = names.suggest(index, query, 5)
        assert read and sum(read) < 4_000, (query, read)
        assert got == [tuple(r) for r in collect(lookup.suggest(nodes, query, 5))]
    read.clear()
    assert names.find(index, some.upper()).collect()[0].id == 77 and sum(read) < 1_000
