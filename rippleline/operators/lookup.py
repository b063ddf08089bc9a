"""Finding symbols, and what comes closest when there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rippleline.functions.text import ascii_lower, similarity
from rippleline.operators import names
from rippleline.operators.names import Names

SUGGESTIONS = 5


def find(nodes: DataFrame, query: str) -> DataFrame:
    """The node with this full key, or else with this name, case aside; the smallest id. At most one row."""
    wanted = ascii_lower(F.lit(query))
    key = ascii_lower(F.concat_ws(".", "schema", "name"))
    rank = F.when(key == wanted, 0).when(ascii_lower(F.col("name")) == wanted, 1)
    return nodes.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", "id").limit(1).drop("_rank")


def suggest(nodes: DataFrame, query: str, limit: int = SUGGESTIONS) -> DataFrame:
    """(key, score) of the most similar keys, best first."""
    keys = nodes.select(F.concat_ws(".", "schema", "name").alias("key")).distinct()
    return keys.withColumn("score", similarity(F.col("key"), F.lit(query)).cast("int")).where("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def first_coverage(found: DataFrame) -> DataFrame:
    """found(source_ord, service, has_dump), a row a source -> (service, has_dump): the first source of a service holds."""
    return found.groupBy("service").agg(F.min_by("has_dump", "source_ord").alias("has_dump"))


def without_dump(coverage: DataFrame) -> DataFrame:
    """(service) of those without a dictionary dump, each once."""
    return coverage.where(~F.coalesce("has_dump", F.lit(False))).select("service").distinct()


def first(nodes: DataFrame | Names, query: str) -> Row | None:
    """The node that `find` gives, by the index of names where there is one."""
    return (names.find(nodes, query) if isinstance(nodes, Names) else find(nodes, query)).first()


def closest(nodes: DataFrame | Names, query: str) -> list[str]:
    """The keys that `suggest` gives."""
    if isinstance(nodes, Names):
        return [key for key, _ in names.suggest(nodes, query, SUGGESTIONS)]
    return [r.key for r in suggest(nodes, query).collect()]


def find_or_suggest(nodes: DataFrame | Names, query: str) -> tuple[Row | None, str]:
    """The node, or None and a message with the closest keys."""
    if (found := first(nodes, query)) is not None:
        return found, ""
    close = closest(nodes, query)
    return None, f"not found: {query}" + (f" — closest: {', '.join(close)}" if close else "")
