"""Command line: python -m rippleline.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from rippleline import render
from rippleline.api import Engine, NotFound
from rippleline.serve import serve
from rippleline.sources.config import discover, load_config
from rippleline.sources.dictionary import dictionary_query


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rippleline")
    p.add_argument("--config")
    p.add_argument("--no-lease", action="store_true", help="write no lease: for a store that may only be read")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("sync")
    c.add_parser("serve")
    for name, depth in (("callers", 1), ("deps", 1), ("impact", 5)):
        q = c.add_parser(name)
        q.add_argument("name")
        q.add_argument("--depth", type=int, default=depth)
        if name == "impact":
            q.add_argument("--include-weak", action="store_true")
    for name in ("topic", "symbol", "chunk"):
        c.add_parser(name).add_argument("name")
    c.add_parser("describe").add_argument("--full", action="store_true")
    c.add_parser("dd-query").add_argument("schema")
    a = c.add_parser("affected")
    a.add_argument("--fail-on", choices=["cross-service"])
    a.add_argument("--out", choices=["md", "json"], default="md")
    return p


def run(args: argparse.Namespace, spark, diff: str = "") -> tuple[str, int]:
    """(what to print, exit code)."""
    with _engine(args, spark) as engine:
        return _run(engine, args, diff)


def _engine(args: argparse.Namespace, spark) -> Engine:
    config = load_config(args.config) if args.config else discover()
    return Engine(spark, config, hold=0) if getattr(args, "no_lease", False) else Engine(spark, config)


def _run(engine: Engine, args: argparse.Namespace, diff: str) -> tuple[str, int]:
    try:
        if args.command == "sync":
            r = engine.sync()
            counters = f"services={r.services} defs={r.defs} edges={r.edges} unresolved_topics={r.unresolved} invokes_noise_dropped={r.invokes_dropped} code_dynamic_tables={r.dynamic_tables} redis_dynamic_keys={r.dynamic_keys}" + (f" unreadable_files={r.unreadable}" if r.unreadable else "")
            sites = [f"  {x.loc}:{x.line}" for x in engine.store.unresolved.orderBy("seq").limit(20).collect()]
            more = [f"  … and {r.unresolved - 20} more"] if r.unresolved > 20 else []
            return "\n".join([f"synced: {counters}", *(["unresolved call sites (declare them in topics.toml):"] if sites else []), *sites, *more]), 0
        if args.command in ("callers", "deps"):
            return render.reached_lines(getattr(engine, args.command)(args.name, args.depth).collect()), 0
        if args.command == "impact":
            return render.impact_lines(engine.impact(args.name, args.depth, args.include_weak).collect()), 0
        if args.command == "topic":
            producers, consumers = engine.topic(args.name)
            return f"{args.name}\nproducers: {producers}\nconsumers: {consumers}", 0
        if args.command == "describe":
            return engine.describe(args.full), 0
        if args.command in ("symbol", "chunk"):
            return getattr(engine, args.command)(args.name), 0
        report = engine.affected(diff)
    except NotFound as e:
        return str(e), 1 if args.command == "topic" else 0
    if report is None:
        return "no changed hunks in diff", 0
    text = render.affected_json(report) if args.out == "json" else render.affected_md(report)
    return text, 1 if args.fail_on and report.cross_service else 0


def main() -> int:
    args = parser().parse_args()
    if args.command == "dd-query":
        print(dictionary_query(args.schema))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("rippleline").getOrCreate()
    if args.command == "serve":
        with _engine(args, spark) as engine:
            serve(engine, sys.stdin, sys.stdout)
        return 0
    text, code = run(args, spark, sys.stdin.read() if args.command == "affected" else "")
    print(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
