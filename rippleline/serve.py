"""The questions as tools over standard input and output: JSON-RPC, one message a line."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import IO, Any

from rippleline import render
from rippleline.api import Engine, NotFound
from rippleline.operators.graph import CAP

PROTOCOL = "2024-11-05"

_NAME = {"name": {"type": "string", "description": "Symbol: bare or SCHEMA.NAME"}}
_COUNT = {"type": "integer", "minimum": 0}
_DEPTH = {**_NAME, "depth": _COUNT, "max_results": _COUNT}

Tool = tuple[str, dict[str, Any], Callable[..., str]]


def _topic(engine: Engine, name: str) -> str:
    producers, consumers = engine.topic(name)
    return f"{name}\nproducers: {producers}\nconsumers: {consumers}"


def _cap(max_results: int) -> int:
    """How far a search goes: to its usual cap, or as far as is asked for."""
    return max(CAP, max_results)


# Names, parameters and defaults of the tools.
TOOLS: dict[str, Tool] = {
    "describe_corpus": ("Counts, samples, age and coverage of the store.", {}, lambda e: e.describe(full=True)),
    "get_symbol": ("What a symbol is, and where it is defined.", {**_NAME, "include_path": {"type": "boolean"}}, lambda e, name, include_path=False: e.symbol(name, include_path)),
    "get_callers": ("What refers to a symbol.", _DEPTH, lambda e, name, depth=1, max_results=50: render.reached_lines(e.callers(name, depth, cap=_cap(max_results)).collect(), max_results)),
    "get_dependencies": ("What a symbol depends on.", _DEPTH, lambda e, name, depth=1, max_results=50: render.reached_lines(e.deps(name, depth, cap=_cap(max_results)).collect(), max_results)),
    "get_impact": (
        "What a change of a symbol reaches, by depth.",
        {**_DEPTH, "include_weak": {"type": "boolean"}},
        lambda e, name, depth=5, max_results=200, include_weak=False: render.impact_lines(e.impact(name, depth, include_weak, _cap(max_results)).collect(), max_results, _cap(max_results)),
    ),
    "get_topic": ("Producers and consumers of a topic, with evidence.", _NAME, _topic),
    "get_chunk": (
        "Signature or body of a definition.",
        {**_NAME, "signature_only": {"type": "boolean"}, "max_lines": _COUNT},
        lambda e, name, signature_only=True, max_lines=40: e.chunk(name, signature_only, max_lines),
    ),
}


def answer(engine: Engine, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to a message; None for notifications."""
    if "id" not in message:
        return None
    method, params = message.get("method"), message.get("params") or {}
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "rippleline", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": ["name"] if p else []}} for n, (d, p, _) in TOOLS.items()]
        return reply | {"result": {"tools": tools}}
    if method != "tools/call":
        return reply | {"error": {"code": -32601, "message": f"no method {method}"}}
    name, given = params.get("name"), {k: v for k, v in (params.get("arguments") or {}).items() if v is not None}
    if name not in TOOLS or not given.keys() <= TOOLS[name][1].keys() or TOOLS[name][1] and "name" not in given:
        return reply | {"error": {"code": -32602, "message": f"no such tool or arguments: {name}"}}
    try:
        text = TOOLS[name][2](engine, **given)
    except NotFound as e:
        text = str(e)
    return reply | {"result": {"content": [{"type": "text", "text": text}]}}


def serve(engine: Engine, source: IO[str], out: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except json.JSONDecodeError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
