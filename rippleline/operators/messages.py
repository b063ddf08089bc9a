"""Topics that code publishes to and consumes from, and procedures that it invokes, by patterns of each line.

Constants are collected per file and carried as an array next to the lines, so a file is resolved where it was read:
no join, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleline.functions.text import CALL_KEYWORDS, lines

# By language, constants (name, value) and the arguments of consuming and publishing calls.
PATTERNS = {
    "go": {
        "consts": [r'const\s+(\w+)\s*=\s*"([^"]+)"', r'\t(\w+)\s*=\s*"([a-z][\w\-.]+)"'],
        "Consumes": [r"(?:kgo\.|\.Add)ConsumeTopics\((.*?)\)", r"\.ConsumePartition\(\s*([^,]+)", r"Consume\([^,]+,\s*\[\]string\{(.*?)\}", r"\.Consume\([^,]+,\s*\[?([^)\]]*)"],
        "Publishes": [r"kgo\.DefaultProduceTopic\(\s*([^)]*)", r"(?:Record|ProducerMessage)\{\s*(?:Topic|topic):?\s*([^,}]*)"],
    },
    "rust": {
        "consts": [r'const\s+(\w+):\s*&str\s*=\s*"([^"]+)"'],
        "Consumes": [r"\.subscribe\(&\[(.*?)\]"],
        "Publishes": [r"(?:FutureRecord|BaseRecord)::to\(\s*([^)]*)"],
    },
    "cpp": {
        "consts": [r'constexpr\s+(?:auto|const\s+char\*)\s+(\w+)\s*=\s*"([^"]+)"', r'static\s+const\s+std::string\s+(\w+)\s*=\s*"([^"]+)"'],
        "Consumes": [r"\.subscribe\(\{(.*?)\}\)", r"TopicPartition::create\(\s*([^,]+)"],
        "Publishes": [r"Topic::create\(\s*[^,]+,\s*([^,]+)", r'\.produce\(\s*("[^"]+"|\w+)'],
    },
}
PROC_CONST = r'(?:const|static)\s+(\w+)[^=]*=\s*"([A-Z][A-Z0-9_]{2,})"'
PROC_QUOTED = r'"([A-Z][A-Z0-9_]{2,})"'
PROC_BARE = r"\b([A-Z][A-Z0-9_]{2,})\b"
KINDS = ("Consumes", "Publishes")


def _pairs(text: Column, patterns: list[str]) -> Column:
    """Array of (name, value) in order of patterns and matches."""
    found = [F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(p), F.lit(2)).alias("value")) for p in patterns]
    return F.concat(*found) if len(found) > 1 else found[0]


def _last(consts: Column, name: Column) -> Column:
    """The last value given to a name, or null."""
    return F.try_element_at(F.filter(consts, lambda c: c["name"] == name), F.lit(-1))["value"]


def _arguments(line: Column, lang: str) -> Column:
    """Array of (kind, pattern, match, argument) of a line."""
    out = []
    for k, kind in enumerate(KINDS):
        for p, pattern in enumerate(PATTERNS[lang][kind]):
            one = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
            out.append(F.transform(one, _tagged(k, p, kind)))
    return F.concat(*out)


def _tagged(k: int, p: int, kind: str):
    return lambda x, i: F.struct(F.lit(k).alias("k"), F.lit(p).alias("p"), i.alias("i"), F.lit(kind).alias("kind"), x.alias("raw"))


def topic_sites(files: DataFrame) -> DataFrame:
    """(seq, kind, service, topic, path, line); topic is null where the argument is no literal and no known constant."""
    per_lang = None
    for lang in PATTERNS:
        some = files.where(F.col("lang") == lang)
        each = some.select("service", "source_ord", "path", _pairs(F.col("content"), PATTERNS[lang]["consts"]).alias("consts"), F.posexplode(lines(F.col("content"))).alias("at", "text"))
        hits = each.select("service", "source_ord", "path", "consts", "at", F.explode(_arguments(F.col("text"), lang)).alias("hit"))
        args = hits.select("*", F.posexplode(F.filter(F.transform(F.split("hit.raw", ","), lambda t: F.trim(t)), lambda t: t != "")).alias("a", "arg"))
        per_lang = args if per_lang is None else per_lang.unionByName(args)
    arg = F.col("arg")
    literal = (F.length(arg) >= 2) & arg.startswith('"') & arg.endswith('"')
    name = F.regexp_replace(arg, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    topic = F.when(literal, F.substring(arg, F.lit(2), F.length(arg) - 2)).otherwise(_last(F.col("consts"), name))
    seq = F.array(F.lit("2"), F.format_string("%06d", "source_ord"), F.lit("0"), F.col("path"), F.format_string("%09d", "at"), F.format_string("%d%02d%06d%06d", "hit.k", "hit.p", "hit.i", "a"))
    return per_lang.select(seq.alias("seq"), F.col("hit.kind").alias("kind"), "service", F.nullif(topic, F.lit("")).alias("topic"), "path", (F.col("at") + 1).cast("int").alias("line"))


def topic_edges(sites: DataFrame) -> DataFrame:
    return sites.where("topic is not null").select("seq", "kind", F.col("service").alias("src"), F.col("topic").alias("dst"), "path", "line", F.lit(None).cast("string").alias("from_kind"))


def unresolved(sites: DataFrame) -> DataFrame:
    """(seq, loc, line): call sites whose topic isn't known. Not deduplicated."""
    return sites.where("topic is null").select("seq", F.concat_ws(":", "service", "path").alias("loc"), "line")


def invokes(files: DataFrame) -> DataFrame:
    """Raw edges to names shaped like procedures on lines that look like calls; what isn't a known procedure goes later."""
    each = files.where(F.col("lang").isin(*PATTERNS)).select("service", "source_ord", "path", _pairs(F.col("content"), [PROC_CONST]).alias("consts"), F.posexplode(lines(F.col("content"))).alias("at", "text"))
    line = F.col("text")
    is_call = F.lit(False)
    for word in CALL_KEYWORDS:
        is_call = is_call | line.contains(word)
    resolve = lambda n: F.coalesce(_last(F.col("consts"), n), n)
    quoted = F.transform(F.regexp_extract_all(line, F.lit(PROC_QUOTED), F.lit(1)), resolve)
    bare = F.filter(F.regexp_extract_all(line, F.lit(PROC_BARE), F.lit(1)), lambda n: ~F.array_contains(F.col("quoted"), n))
    named = each.where(is_call).withColumn("quoted", quoted).select("service", "source_ord", "path", "at", F.posexplode(F.array_distinct(F.concat("quoted", F.transform(bare, resolve)))).alias("i", "name"))
    seq = F.array(F.lit("2"), F.format_string("%06d", "source_ord"), F.lit("1"), F.col("path"), F.format_string("%09d", "at"), F.format_string("%06d", "i"))
    return named.select(seq.alias("seq"), F.lit("Invokes").alias("kind"), F.col("service").alias("src"), F.col("name").alias("dst"), "path", (F.col("at") + 1).cast("int").alias("line"), F.lit(None).cast("string").alias("from_kind"))
