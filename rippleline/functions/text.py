"""Text functions as Column expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Words that are no object names, by context.
PLSQL_NOISE = (
    "IF FOR WHILE LOOP CASE ELSE ELSIF SELECT INSERT UPDATE DELETE MERGE INTO EXECUTE EXEC OPEN FETCH CLOSE DECLARE NULL "
    "EXIT RETURN RAISE COMMIT ROLLBACK BEGIN END EXCEPTION WHEN THEN LOCK CREATE DROP ALTER TRUNCATE"
).split()
SQL_NOISE = (
    "DUAL SELECT WHERE SET VALUES AND OR AS ON BY GROUP ORDER INNER LEFT RIGHT OUTER JOIN FROM INTO UPDATE TABLE ONLY USING "
    "RETURNING BEGIN END NULL"
).split()
CALL_KEYWORDS = ("Exec", "Query", "QueryRow", "Prepare", "Get", "Select", ".execute(", ".query(", "prepare(", "CALL ", "EXEC ", "EXECUTE ", "Command(", "Run(")

# The shapes of SQL in a string literal. Classes are ASCII, so that all engines agree.
LOOKS_LIKE_SQL = r"(?i)^\s*(?:with\s|select\s|insert\s+into\s|update\s+[a-z_\x22]|delete\s+from\s|merge\s+into\s|begin\s|call\s|exec(?:ute)?\s)"
TABLE_REF = r"(?i)\b(?:from|join|into|update)\s+(?:\"?[A-Za-z_][\w$#]*\"?\s*\.\s*)?\"?([A-Za-z_][\w$#]*)\"?"
PROC_CALL = r"(?i)\b(?:begin|call|exec(?:ute)?)\s+([A-Za-z_][\w$#]*)\s*\(?"
DYNAMIC_TABLE = r"(?i)\b(?:from|join|into|update)\s+(%s|\$\d+|:\w+|\?)"
PRINTF = r"%[-+ #0-9.*]*[a-zA-Z]"


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def lines(content: Column) -> Column:
    """Lines without their ends; a last empty one isn't a line."""
    parts = F.split(content, r"\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def looks_like_sql(text: Column) -> Column:
    return text.rlike(LOOKS_LIKE_SQL)


def squeeze(text: Column) -> Column:
    """Quotes and backticks to spaces, runs of white space to one."""
    return F.trim(F.regexp_replace(F.translate(text, '"`', "  "), r"\s+", " "))


def _names(text: Column, pattern: str) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ascii_upper)
    return F.array_distinct(F.filter(found, lambda n: ~n.isin(SQL_NOISE)))


def table_refs(text: Column) -> Column:
    return _names(text, TABLE_REF)


def proc_calls(text: Column) -> Column:
    return _names(text, PROC_CALL)


def dynamic_tables(text: Column) -> Column:
    return F.regexp_count(text, F.lit(DYNAMIC_TABLE))


def key_pattern(raw: Column) -> Column:
    """Format verbs to stars, runs of stars to one; null without a letter or digit to hold on to."""
    pattern = F.trim(F.regexp_replace(F.regexp_replace(raw, PRINTF, "*"), r"\*{2,}", "*"))
    return F.when(pattern.rlike(r"[\p{L}\p{N}]"), pattern)


def signature(body: Column) -> Column:
    """Up to the first " as ", " is " or " return ", or else the first line; 256 characters."""
    flat = F.replace(body, F.lit("\n"), F.lit(" "))
    at = F.regexp_instr(flat, F.lit("(?i) (?:as|is|return) "))
    return F.substring(F.trim(F.when(at > 0, F.substring(flat, F.lit(1), at - 1)).otherwise(F.substring_index(body, "\n", 1))), 1, 256)


def tokens(key: Column) -> Column:
    """Upper-case alphanumeric parts of an identifier."""
    return F.filter(F.split(ascii_upper(key), "[^A-Z0-9]+"), lambda t: t != "")


def common_prefix(a: Column, b: Column, most: int = 6) -> Column:
    """Length of the common prefix, up to a bound."""
    same = [F.when(F.substring(a, 1, i) == F.substring(b, 1, i), (F.length(a) >= i) & (F.length(b) >= i)).otherwise(False).cast("int") for i in range(1, most + 1)]
    return sum(same[1:], same[0])


def similarity(key: Column, query: Column) -> Column:
    """4 for each token of the key that the query has, 3 if one contains the other, and the common prefix up to 6."""
    k, q = ascii_upper(key), ascii_upper(query)
    wanted = tokens(q)
    shared = F.size(F.filter(tokens(k), lambda t: F.array_contains(wanted, t)))
    return shared * 4 + F.when(F.contains(k, q) | F.contains(q, k), 3).otherwise(0) + common_prefix(k, q)


def age(seconds: Column) -> Column:
    """Seconds in words."""
    return (
        F.when(seconds < 60, F.format_string("%ds ago", seconds))
        .when(seconds < 3600, F.format_string("%dm ago", (seconds / 60).cast("long")))
        .when(seconds < 86400, F.format_string("%dh ago", (seconds / 3600).cast("long")))
        .otherwise(F.format_string("%dd ago", (seconds / 86400).cast("long")))
    )
