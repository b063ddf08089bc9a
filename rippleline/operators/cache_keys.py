"""Cache (Redis) keys that code reads and writes.

One pass over tokens of each file gives call candidates with a key pattern for each argument, and functions of Go that
hand one of their parameters on as a key. Those wrappers hold for a whole service, so they meet the candidates in a
join on (service, method). A key that can't be told is counted, not guessed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleline.functions.text import PRINTF
from rippleline.operators.graph import rank_first
from rippleline.operators.lexer import Token, closing, opening, split_args, tokens, unquote
from rippleline.operators.messages import PATTERNS
from rippleline.operators.scan import table_function

# Verbs that read and verbs that write.
READ_VERBS = (
    "GET GETEX GETRANGE MGET STRLEN EXISTS TYPE TTL PTTL HGET HGETALL HMGET HKEYS HVALS HEXISTS HLEN LRANGE LINDEX LLEN LPOS "
    "SMEMBERS SISMEMBER SCARD SRANDMEMBER ZRANGE ZSCORE ZRANK ZCARD ZRANGEBYSCORE ZCOUNT KEYS SCAN BITCOUNT DUMP"
).split()
WRITE_VERBS = (
    "SET SETEX SETNX SETXX MSET MSETNX GETSET GETDEL APPEND DEL UNLINK EXPIRE EXPIREAT PEXPIRE PERSIST RENAME RENAMENX SETRANGE "
    "SETBIT INCR INCRBY DECR DECRBY INCRBYFLOAT HSET HMSET HSETNX HDEL HINCRBY HINCRBYFLOAT LPUSH RPUSH LPUSHX RPUSHX LPOP RPOP "
    "LSET LREM LTRIM SADD SREM SPOP SMOVE ZADD ZREM ZINCRBY ZREMRANGEBYSCORE"
).split()
VERBS = {**dict.fromkeys(READ_VERBS, "ReadsKey"), **dict.fromkeys(WRITE_VERBS, "WritesKey")}
CPP_COMMANDS = ("redisCommand", "redisCommandArgv", "redisAsyncCommand")
_PRINTF = re.compile(PRINTF)

CALLS = "service string, source_ord int, path string, pos int, line int, method string, kind string, keys array<string>"
WRAPPERS = "service string, path string, pos int, method string, kind string, idx int"


def verb_kind(verb: str) -> str | None:
    return VERBS.get(verb.upper())


def key_pattern(raw: str) -> str | None:
    """Format verbs to stars; None if nothing but stars and punctuation is left."""
    pattern = re.sub(r"\*{2,}", "*", _PRINTF.sub("*", raw)).strip()
    return pattern if any(c.isalnum() for c in pattern) else None


def _is(t: Token, text: str) -> bool:
    return t.kind in ("op", "name") and t.text == text


def go_key(arg: list[Token], variables: dict[str, str]) -> str | None:
    """Literal, variable, Sprintf, or a sum that starts with a literal."""
    if not arg:
        return None
    first = arg[0]
    if len(arg) == 1:
        if first.kind == "string":
            return key_pattern(unquote(first.text))
        return variables.get(first.text) if first.kind == "name" else None
    if first.kind == "string":
        return key_pattern(unquote(first.text) + "*") if arg[1].kind == "op" and arg[1].text in "+-*/%" else None
    if len(arg) >= 5 and _is(arg[-1], ")") and (i := opening(arg, len(arg) - 1)) >= 2 and _is(arg[i - 1], "Sprintf") and _is(arg[i - 2], "."):
        inner = split_args(arg[i + 1 : -1])
        return key_pattern(unquote(inner[0][0].text)) if inner and len(inner[0]) == 1 and inner[0][0].kind == "string" else None
    return None


def go_variables(toks: list[Token]) -> dict[str, str]:
    """Names given a pattern somewhere in the file; the last one holds."""
    out: dict[str, str] = {}
    for i, t in enumerate(toks):
        if not (t.kind == "op" and t.text in (":=", "=", "+=") and i and toks[i - 1].kind == "name"):
            continue
        if i > 1 and (toks[i - 2].text in (".", ",") or toks[i - 2].text in ("const", "var") or toks[i - 2].line == toks[i - 1].line and toks[i - 2].kind in ("name", "string", "number") and toks[i - 2].text not in ("if", "for", "switch", "else", "case")):
            continue
        end, depth = i + 1, 0
        while end < len(toks):
            u = toks[end]
            if u.kind == "op" and u.text in "([":
                depth += 1
            elif u.kind == "op" and u.text in ")]":
                depth -= 1
            if depth < 0 or depth == 0 and (u.text in (";", "{", ",") and u.kind == "op" or end > i + 1 and u.line > toks[end - 1].line and not (toks[end - 1].kind == "op" and toks[end - 1].text not in ")]}")):
                break
            end += 1
        if end < len(toks) and _is(toks[end], ",") and depth == 0:
            continue
        pattern = go_key(toks[i + 1 : end], out)
        if pattern is not None:
            out[toks[i - 1].text] = pattern
    return out


def _receiver_line(toks: list[Token], dot: int) -> int:
    """Line where the expression before a dot starts."""
    i = dot - 1
    while i > 0:
        if toks[i].kind == "op" and toks[i].text in ")]":
            i = opening(toks, i)
            if i and toks[i - 1].kind == "name":
                i -= 1
                continue
        if i > 1 and _is(toks[i - 1], "."):
            i -= 2
            continue
        break
    return toks[max(i, 0)].line


def go_calls(toks: list[Token]) -> list[tuple[int, int, str, list[list[Token]]]]:
    """(token index, line, method, arguments) of each call through a selector."""
    out = []
    for i in range(1, len(toks) - 2):
        if _is(toks[i], ".") and toks[i + 1].kind == "name" and _is(toks[i + 2], "("):
            out.append((i, _receiver_line(toks, i), toks[i + 1].text, split_args(toks[i + 3 : closing(toks, i + 2)])))
    return out


def native(method: str, args: list[list[Token]]) -> str | None:
    """The kind of access if this is a client's own verb: its first argument is a context, the second the key."""
    kind = verb_kind(method)
    if kind is None or len(args) < 2:
        return None
    first = "".join(t.text for t in args[0]).lower()
    return kind if "ctx" in first or "context" in first else None


def go_params(toks: list[Token]) -> list[str]:
    parts = split_args(toks)
    named = any(len(p) > 1 and p[0].kind == "name" and not _is(p[1], ".") for p in parts)
    return [p[0].text for p in parts if p[0].kind == "name"] if named else []


def go_wrappers(toks: list[Token]) -> list[tuple[int, str, str, int]]:
    """(token index, name, kind, parameter) of functions whose first native call has a parameter as its key."""
    out = []
    for i, t in enumerate(toks):
        if not _is(t, "func"):
            continue
        j = i + 1
        if j < len(toks) and _is(toks[j], "("):
            j = closing(toks, j) + 1
        if j + 1 >= len(toks) or toks[j].kind != "name" or not _is(toks[j + 1], "("):
            continue
        end = closing(toks, j + 1)
        body = end + 1
        while body < len(toks) and not _is(toks[body], "{") and not _is(toks[body], "func"):
            body = closing(toks, body) + 1 if _is(toks[body], "(") else body + 1
        if body >= len(toks) or not _is(toks[body], "{"):
            continue
        params = go_params(toks[j + 2 : end])
        for _, _, method, args in go_calls(toks[body : closing(toks, body)]):
            if kind := native(method, args):
                key = "".join(x.text for x in args[1])
                if key in params:
                    out.append((i, toks[j].text, kind, params.index(key)))
                break
    return out


def rust_key(arg: list[Token]) -> str | None:
    if len(arg) == 1 and arg[0].kind == "string":
        return key_pattern(unquote(arg[0].text))
    for i in range(1, len(arg) - 1):
        if _is(arg[i], "!") and arg[i - 1].kind == "name" and arg[i + 1].text in "([{":
            inner = arg[i + 2 : closing(arg, i + 1)]
            found = next((t for t in inner if t.kind == "string"), None)
            return key_pattern(unquote(found.text).replace("{}", "*")) if found else None
    return None


def rust_calls(toks: list[Token]) -> list[tuple[int, int, str, str | None]]:
    """(token index, line, kind, key) of cmd("VERB").arg(key) and of recv.verb::<T>(key)."""
    out = []
    for i, t in enumerate(toks):
        if _is(t, "cmd") and i + 2 < len(toks) and _is(toks[i + 1], "(") and toks[i + 2].kind == "string":
            end = closing(toks, i + 1)
            if end + 3 < len(toks) and _is(toks[end + 1], ".") and _is(toks[end + 2], "arg") and _is(toks[end + 3], "("):
                if kind := verb_kind(unquote(toks[i + 2].text)):
                    args = split_args(toks[end + 4 : closing(toks, end + 3)])
                    out.append((i, t.line, kind, rust_key(args[0]) if args else None))
        if _is(t, ".") and i + 3 < len(toks) and toks[i + 1].kind == "name" and _is(toks[i + 2], "::") and _is(toks[i + 3], "<"):
            depth, j = 0, i + 3
            while j < len(toks):
                depth += toks[j].text == "<"
                depth -= toks[j].text == ">"
                if depth == 0:
                    break
                j += 1
            kind = verb_kind(toks[i + 1].text)
            if kind and j + 1 < len(toks) and _is(toks[j + 1], "("):
                args = split_args(toks[j + 2 : closing(toks, j + 1)])
                out.append((i, _receiver_line(toks, i), kind, rust_key(args[0]) if args else None))
    return out


def cpp_calls(toks: list[Token]) -> list[tuple[int, int, str, str | None]]:
    """(token index, line, kind, key) of commands whose first literal argument is "VERB key ..."."""
    out = []
    for i, t in enumerate(toks):
        if t.kind != "name" or t.text not in CPP_COMMANDS or i + 1 >= len(toks) or not _is(toks[i + 1], "(") or i and toks[i - 1].text in ("::", ".", "->"):
            continue
        args = split_args(toks[i + 2 : closing(toks, i + 1)])
        literal = next((a for a in args if all(x.kind == "string" for x in a)), None)
        parts = " ".join(unquote(x.text) for x in literal).split() if literal else []
        if parts and (kind := verb_kind(parts[0])):
            out.append((i, t.line, kind, key_pattern(parts[1]) if len(parts) > 1 else None))
    return out


def scan_calls(lang: str, source: str) -> list[tuple[int, int, str | None, str | None, list[str | None]]]:
    """(position, line, method, kind, keys). kind is set where the access is certain, and then there is one key; other calls
    through a selector have a key for each argument, as a wrapper may take any."""
    toks = tokens(lang, source)
    if lang == "rust":
        return [(i, line, None, kind, [key]) for i, line, kind, key in rust_calls(toks)]
    if lang == "cpp":
        return [(i, line, None, kind, [key]) for i, line, kind, key in cpp_calls(toks)]
    known, out = go_variables(toks), []
    for i, line, method, args in go_calls(toks):
        if kind := native(method, args):
            out.append((i, line, method, kind, [go_key(args[1], known)]))
        elif args:
            out.append((i, line, method, None, [go_key(a, known) for a in args]))
    return out


def calls(files: DataFrame) -> DataFrame:
    def scan(service: str, source_ord: int, path: str, lang: str, content: str) -> list[tuple]:
        return [(service, source_ord, path, *c) for c in scan_calls(lang, content)]

    return table_function(files.where(F.col("lang").isin(*PATTERNS)), ("service", "source_ord", "path", "lang", "content"), scan, CALLS)


def wrappers(files: DataFrame) -> DataFrame:
    """(service, method, kind, idx): the first definition of a name in a service holds."""

    def scan(service: str, path: str, content: str) -> list[tuple]:
        return [(service, path, *w) for w in go_wrappers(tokens("go", content))]

    found = table_function(files.where("lang = 'go'"), ("service", "path", "content"), scan, WRAPPERS)
    return rank_first(found, ["service", "method"], ["path", "pos"]).select("service", "method", "kind", "idx")


def accesses(found: DataFrame, known: DataFrame) -> DataFrame:
    """(service, source_ord, path, pos, line, kind, key): native calls and calls of wrappers; key is null if it can't be told."""
    sure = found.where("kind is not null").select("service", "source_ord", "path", "pos", "line", "kind", F.get("keys", F.lit(0)).alias("key"))
    maybe = found.where("kind is null").drop("kind").join(known, ["service", "method"]).where(F.col("idx") < F.size("keys"))
    return sure.unionByName(maybe.select("service", "source_ord", "path", "pos", "line", "kind", F.get("keys", "idx").alias("key")))


def key_edges(found: DataFrame) -> DataFrame:
    seq = F.array(F.lit("2"), F.format_string("%06d", "source_ord"), F.lit("2"), F.col("path"), F.lit("0"), F.format_string("%09d", "pos"))
    return found.where("key is not null").select(seq.alias("seq"), "kind", F.col("service").alias("src"), F.col("key").alias("dst"), "path", "line", F.lit("Service").alias("from_kind"))
