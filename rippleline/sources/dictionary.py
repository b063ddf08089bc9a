"""Dictionary dumps: CSV with name, type, ref_name, ref_type; and the query that makes one."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.functions.text import ascii_upper

PATH = "<dictionary>"

# The parts of the dictionary query, for the database and for Spark.
_BEGIN_NAME, _BEGIN_CALL = r"Begin[[:space:]]+([A-Za-z_][A-Za-z0-9_]*)", r"Begin[[:space:]]+[A-Za-z_][A-Za-z0-9_]*[[:space:]]*\("
_OBJECTS = "'PROCEDURE','FUNCTION','PACKAGE','PACKAGE BODY'"
_REFERENCED = "'PROCEDURE','FUNCTION','TABLE','VIEW','PACKAGE'"
_NOT_CALLS = (
    "'IF','FOR','WHILE','LOOP','CASE','SELECT','INSERT','UPDATE','DELETE','NULL','DECLARE','END','EXCEPTION','EXECUTE','RETURN','RAISE',"
    "'COMMIT','ROLLBACK','THEN','MERGE','INTO','ELSE','ELSIF','WHEN','LOCK','CREATE','DROP','ALTER','TRUNCATE','OPEN','FETCH','CLOSE'"
)


def slug(service: str) -> str:
    return re.sub(r"[^\w-]|_", "_", service)


def dump_path(store: str, service: str) -> str:
    """Where a service's dump is expected: beside the store."""
    return f"{store.rstrip('/').rpartition('/')[0]}/{slug(service)}-dependencies.csv"


def dictionary_query(schema: str) -> str:
    """SQL to run in the database for the dump: static references, and calls in source text that they miss."""
    owner = "UPPER('" + schema.replace("'", "''") + "')"
    call = "UPPER(REGEXP_SUBSTR(s.text, '" + _BEGIN_NAME + "', 1, 1, 'i', 1))"
    static = (
        f"SELECT name, type, referenced_name AS ref_name, referenced_type AS ref_type FROM all_dependencies WHERE owner = {owner} "
        f"AND type IN ({_OBJECTS}) AND referenced_type IN ({_REFERENCED}) AND referenced_owner = {owner}"
    )
    scanned = (
        f"SELECT DISTINCT s.name, s.type, {call} AS ref_name, 'PROCEDURE' AS ref_type FROM all_source s WHERE s.owner = {owner} "
        f"AND s.type IN ('PROCEDURE','FUNCTION','PACKAGE BODY') "
        f"AND REGEXP_LIKE(s.text, '{_BEGIN_CALL}', 'i') AND {call} NOT IN ({_NOT_CALLS})"
    )
    return f"{static} UNION {scanned}"


def dictionary_rows(dependencies: DataFrame, source: DataFrame, schema: str) -> DataFrame:
    """The same query over all_dependencies and all_source as tables in Spark."""
    spark = dependencies.sparkSession
    dependencies.createOrReplaceTempView("rippleline_all_dependencies")
    source.createOrReplaceTempView("rippleline_all_source")
    call = r"upper(regexp_extract(text, '(?i)Begin\\s+([A-Za-z_][A-Za-z0-9_]*)', 1))"
    return spark.sql(
        rf"""
        SELECT name, type, referenced_name AS ref_name, referenced_type AS ref_type FROM rippleline_all_dependencies
        WHERE owner = upper(:schema) AND referenced_owner = upper(:schema) AND type IN ({_OBJECTS}) AND referenced_type IN ({_REFERENCED})
        UNION
        SELECT name, type, {call} AS ref_name, 'PROCEDURE' AS ref_type FROM rippleline_all_source
        WHERE owner = upper(:schema) AND type IN ('PROCEDURE','FUNCTION','PACKAGE BODY')
          AND text RLIKE '(?i)Begin\\s+[A-Za-z_][A-Za-z0-9_]*\\s*\\(' AND {call} NOT IN ({_NOT_CALLS})
        """,
        args={"schema": schema},
    )


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, ref_name, ref_type), upper-cased. Fields are split at each comma; short rows are left out. A
    header without name and ref_name is an error. A large dump is read in splits; pos is the place in the file, so it orders rows, with gaps."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    head = spark.read.text(path).first()
    if head is None or "name" not in head.value.lower() or "ref_name" not in head.value.lower():
        raise ValueError(f"{path}: expected a header with name,type,ref_name,ref_type")
    return dump_rows(lines.where("pos > 0"))


def dump_rows(lines: DataFrame) -> DataFrame:
    """Lines (pos, line) of a dump without its header."""
    cols = F.transform(F.split(F.trim("line"), ","), lambda c: F.btrim(F.trim(c), F.lit('"')))
    rows = lines.where("trim(line) <> ''").select("pos", cols.alias("c")).where(F.size("c") >= 4)
    return rows.select("pos", ascii_upper(F.get("c", F.lit(0))).alias("name"), ascii_upper(F.get("c", F.lit(2))).alias("ref_name"), ascii_upper(F.get("c", F.lit(3))).alias("ref_type"))


def dump_edges(rows: DataFrame, service: str, source_ord: int = 0) -> DataFrame:
    """Raw edges: tables and views are touched, procedures, functions and packages called; other kinds go. The
    service stands in for the schema."""
    kind = F.when(F.col("ref_type").isin("TABLE", "VIEW"), "Touches").when(F.col("ref_type").isin("PROCEDURE", "FUNCTION", "PACKAGE"), "Calls")
    key = lambda c: F.concat(ascii_upper(F.lit(service)), F.lit("."), F.col(c))
    seq = F.array(F.lit("1"), F.format_string("%06d", F.lit(source_ord)), F.lit("2"), F.format_string("%019d", "pos"))
    return rows.select(seq.alias("seq"), kind.alias("kind"), key("name").alias("src"), key("ref_name").alias("dst"), F.lit(PATH).alias("path"), F.lit(0).alias("line"), F.lit(None).cast("string").alias("from_kind")).where("kind is not null")
