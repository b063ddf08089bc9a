"""PL/SQL: definitions, ownership, and what dynamic SQL calls and touches.

Definitions are found per file with array functions: a file is one row from scan to definitions, and a definition's
end is the line before the next one's start, so nothing is shuffled. Comments are blanked with their new lines
kept, so lines of stripped and original text agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleline.functions.text import PLSQL_NOISE, ascii_upper, lines, signature
from rippleline.schema import RAW_EDGES

# The shapes of definitions, calls and dynamic statements.
DEFINITION = r'(?i)create\s+(?:or\s+replace\s+)?(procedure|function)\s+(?:"?([\w$#]+)"?\s*\.\s*)?"?([\w$#]+)"?'
_CALL = re.compile(r"\bbegin\s+([A-Za-z_]\w*)\s*\(", re.I | re.A)
_IMMEDIATE = re.compile(r"execute\s+immediate\s*\(?\s*'([^']*)'", re.I)
_TABLE = re.compile(r'\b(?:from|join|update|insert\s+into|merge\s+into)\s+(?:"?[A-Za-z][\w$#]*"?\s*\.\s*)?"?([A-Za-z][\w$#]*)"?', re.I | re.A)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


def blank_comments(text: str) -> str:
    """Without comments; a block comment leaves a space and its new lines. Quotes don't protect comment marks."""
    return _COMMENT.sub(lambda m: "" if m[0].startswith("--") else " " + "\n" * m[0].count("\n"), text)


@F.pandas_udf(T.StringType())
def blank_comments_udf(texts: pd.Series) -> pd.Series:
    return texts.map(blank_comments, na_action="ignore")


def _found(content: Column, stripped: Column) -> Column:
    """Array of (line, kind, schema, name): the first definition of each line."""
    per_line = F.transform(
        lines(stripped),
        lambda line, i: F.struct(
            (i + 1).cast("int").alias("line"),
            F.lower(F.regexp_extract(line, DEFINITION, 1)).alias("kind"),
            ascii_upper(F.regexp_extract(line, DEFINITION, 2)).alias("schema"),
            ascii_upper(F.regexp_extract(line, DEFINITION, 3)).alias("name"),
        ),
    )
    return F.filter(per_line, lambda x: x["kind"] != "")


def definitions(files: DataFrame) -> DataFrame:
    """files of SQL -> raw definitions."""
    base = files.select("service", "source_ord", "path", lines(F.col("content")).alias("lines"), _found(F.col("content"), blank_comments_udf("content")).alias("found"))
    each = base.select("*", F.posexplode("found").alias("pos", "d"))
    last = F.coalesce(F.try_element_at("found", F.col("pos") + 2)["line"] - 1, F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("d.line"), F.greatest(last - F.col("d.line") + 1, F.lit(0))), "\n")
    return each.select(
        "service", "source_ord", "path", "pos", F.col("d.name").alias("title"), F.nullif(F.col("d.schema"), F.lit("")).alias("schema"),
        F.col("d.line").alias("line_start"), last.cast("int").alias("line_end"), body.alias("body"),
        F.when(F.col("d.kind") == "function", "Function").otherwise("Procedure").alias("kind"),
    ).withColumn("signature", signature(F.col("body"))).select("service", "source_ord", "path", "pos", "title", "schema", "line_start", "line_end", "signature", "body", "kind")


def owns(defs: DataFrame) -> DataFrame:
    """One raw edge from the service to each definition."""
    seq = F.array(F.lit("1"), F.format_string("%06d", "source_ord"), F.lit("0"), F.col("path"), F.format_string("%09d", "pos"))
    key = F.concat_ws(".", "schema", "title")
    return defs.select(seq.alias("seq"), F.lit("Owns").alias("kind"), F.col("service").alias("src"), key.alias("dst"), "path", F.col("line_start").alias("line"), F.lit("Service").alias("from_kind"))


def calls_in(body: str, title: str) -> list[tuple[str, int]]:
    """(name, line offset) of calls right after BEGIN, without key words and the definition itself."""
    stripped = blank_comments(body)
    hits = ((m[1].upper(), stripped.count("\n", 0, m.start(1))) for m in _CALL.finditer(stripped))
    return [(n, at) for n, at in hits if n not in PLSQL_NOISE and n != title]


def tables_in(body: str, title: str) -> list[tuple[str, int]]:
    """(table, line offset) of tables in literals given to EXECUTE IMMEDIATE."""
    out = []
    for m in _IMMEDIATE.finditer(body):
        at = body.count("\n", 0, m.start())
        out += [(n, at) for n in (t[1].upper() for t in _TABLE.finditer(m[1])) if n not in PLSQL_NOISE and n not in ("DUAL", title)]
    return out


def dynamic_edges(defs: DataFrame) -> DataFrame:
    """Calls and Touches that only text shows. Their lines come from offsets, which SQL's regular expressions don't give."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for d in frame.itertuples(index=False):
                src = f"{d.schema}.{d.title}" if isinstance(d.schema, str) else d.title
                for phase, kind, found in (("0", "Calls", calls_in(d.body, d.title)), ("1", "Touches", tables_in(d.body, d.title))):
                    for i, (name, at) in enumerate(found):
                        seq = ["1", f"{d.source_ord:06d}", "1", d.path, phase, f"{d.pos:09d}", f"{i:09d}"]
                        rows.append((seq, kind, src, name, d.path, d.line_start + at, None))
            yield pd.DataFrame(rows, columns=["seq", "kind", "src", "dst", "path", "line", "from_kind"])

    return defs.select("source_ord", "path", "pos", "title", "schema", "line_start", "body").mapInPandas(scan, RAW_EDGES)
