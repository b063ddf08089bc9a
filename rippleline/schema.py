"""The property graph: node and edge kinds, and the tables that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_VERSION = 1

NODE_KINDS = ("Procedure", "Function", "Table", "Service", "Topic", "RedisKey")
SQL_KINDS = ("Procedure", "Function", "Table")

# Kind, whether impact follows it forward, whether it is structural only, kinds of its ends.
EDGE_KINDS = (
    ("Calls", False, False, "Procedure", "Procedure"),
    ("Touches", False, False, "Procedure", "Table"),
    ("Publishes", True, False, "Service", "Topic"),
    ("Consumes", False, False, "Service", "Topic"),
    ("Owns", False, True, "Service", "Procedure"),
    ("Invokes", False, False, "Service", "Procedure"),
    ("ReadsKey", False, False, "Service", "RedisKey"),
    ("WritesKey", False, False, "Service", "RedisKey"),
)

FILES = "service string, source_ord int, path string, lang string, content string"
NODES = "id long, name string, schema string, kind string, chunk long"
EDGES = "id long, src long, dst long, kind string, path string, line int, provenance array<long>"
CHUNKS = "id long, service string, path string, kind string, title string, line_start int, line_end int, signature string, body string, node long"
RAW_DEFS = "service string, source_ord int, path string, pos int, title string, schema string, line_start int, line_end int, signature string, body string, kind string"
#: seq orders raw edges as the phases of a sync produce them.
RAW_EDGES = "seq array<string>, kind string, src string, dst string, path string, line int, from_kind string"
REGISTRY = "service string, publishes array<string>, consumes array<string>, provenance map<string,array<string>>"


def edge_kinds(spark: SparkSession) -> DataFrame:
    """The dimension table of edge kinds; eight rows."""
    return spark.createDataFrame(EDGE_KINDS, "kind string, impact_forward boolean, weak boolean, from_kind string, to_kind string")


def impact_forward(kind: Column) -> Column:
    return kind.isin([k for k, forward, *_ in EDGE_KINDS if forward])


def is_weak(kind: Column) -> Column:
    return kind.isin([k for k, _, weak, *_ in EDGE_KINDS if weak])


def node_key(schema: str = "schema", name: str = "name") -> Column:
    """SCHEMA.NAME, or the name alone."""
    return F.concat_ws(".", F.col(schema), F.col(name))
