"""SQL in string literals of code: tables touched and procedures called by a service. Literals come from a lexer in
Python; classifying and reading them are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleline.functions.text import dynamic_tables, looks_like_sql, proc_calls, squeeze, table_refs
from rippleline.operators.lexer import literals
from rippleline.operators.messages import PATTERNS
from rippleline.operators.scan import table_function

_LITERALS = "service string, source_ord int, path string, pos int, text string, line int"


def string_literals(files: DataFrame) -> DataFrame:
    """(service, source_ord, path, pos, text, line), one row a literal."""

    def scan(service: str, source_ord: int, path: str, lang: str, content: str) -> list[tuple]:
        return [(service, source_ord, path, i, text, line) for i, (text, line) in enumerate(literals(lang, content))]

    return table_function(files.where(F.col("lang").isin(*PATTERNS)), ("service", "source_ord", "path", "lang", "content"), scan, _LITERALS)


def sql_literals(found: DataFrame) -> DataFrame:
    return found.withColumn("text", squeeze(F.col("text"))).where(looks_like_sql(F.col("text")))


def sql_edges(sql: DataFrame) -> DataFrame:
    """Raw edges: Touches from the service to tables, then Invokes to procedures."""
    refs = F.concat(
        F.transform(table_refs(F.col("text")), lambda n: F.struct(F.lit("Touches").alias("kind"), n.alias("dst"), F.lit("Service").alias("from_kind"))),
        F.transform(proc_calls(F.col("text")), lambda n: F.struct(F.lit("Invokes").alias("kind"), n.alias("dst"), F.lit(None).cast("string").alias("from_kind"))),
    )
    each = sql.select("*", F.posexplode(refs).alias("i", "ref"))
    seq = F.array(F.lit("2"), F.format_string("%06d", "source_ord"), F.lit("2"), F.col("path"), F.lit("1"), F.format_string("%09d%06d", "pos", "i"))
    return each.select(seq.alias("seq"), F.col("ref.kind").alias("kind"), F.col("service").alias("src"), F.col("ref.dst").alias("dst"), "path", "line", F.col("ref.from_kind").alias("from_kind"))


def dynamic_total() -> Column:
    """The aggregate of SQL literals that counts table positions filled at run time."""
    return F.coalesce(F.sum(dynamic_tables(F.col("text"))), F.lit(0)).cast("long")


def dynamic_count(sql: DataFrame) -> DataFrame:
    """One row: table positions filled at run time."""
    return sql.agg(dynamic_total().alias("dynamic_tables"))
