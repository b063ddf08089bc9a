"""The engine: what can be asked of a store."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rippleline import render
from rippleline.functions.text import lines
from rippleline.operators import adjacency, graph, lookup
from rippleline.operators.adjacency import Walk
from rippleline.operators.diff import Affected, affected, hunks
from rippleline.sources.config import Config
from rippleline.sources.dictionary import dictionary_query
from rippleline.sources.store import HOLD, Store, acquire, load, prune, release, save, versions
from rippleline.sync import Report, sync


class NotFound(LookupError):
    """No such symbol; the message has the closest ones."""


class Engine:
    """Answers from the latest store. Tables are immutable; a newer version is picked up by the next question.

    An engine leases the version it reads for `hold` seconds, and anew when half of them are over; with 0 it leases none, as one has to that may
    only read the store. What a question returned is safe from pruning until the engine takes up a newer version; snapshot() keeps one for longer."""

    def __init__(self, spark: SparkSession, config: Config | None = None, store: Store | None = None, hold: float = HOLD):
        self.spark, self.config, self.hold = spark, config, hold
        self._store, self._version, self._lease, self._renew, self._pinned = store, None, None, 0.0, False

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Give back what the engine holds of a store that it has read itself."""
        if self._version is not None:
            if self._store.steps is not None:
                self._store.steps.close()
            self._store = self._version = None
        self._give_back()

    def _give_back(self) -> None:
        if self._lease is not None:
            release(self.spark, self._lease)
            self._lease = None

    def _take_up(self) -> None:
        """Lease and read the newest version. The lease on an older one is given back when the new one is there."""
        if self.hold > 0:
            version, lease = acquire(self.spark, self.config.store, self.hold)
        else:
            version, lease = versions(self.spark, self.config.store)[-1], None
        try:
            if version != self._version:
                new = load(self.spark, self.config.store, version)
                if self._store is not None and self._store.steps is not None:
                    self._store.steps.close()
                self._store, self._version = new, version
        except BaseException:
            if lease is not None:
                release(self.spark, lease)
            raise
        self._give_back()
        self._lease, self._renew = lease, time.monotonic() + self.hold / 2

    @property
    def store(self) -> Store:
        if self.config is not None and not self._pinned:
            found = versions(self.spark, self.config.store)
            if found and (found[-1] != self._version or self._lease is not None and time.monotonic() > self._renew):
                self._take_up()
        if self._store is None:
            self._store = load(self.spark, self.config.store if self.config else "")
        return self._store

    @contextmanager
    def snapshot(self, hold: float | None = None) -> Iterator[Engine]:
        """An engine that stays with the version that is newest now, for as many seconds, whatever syncs and prunes come."""
        with Engine(self.spark, self.config, self._store if self.config is None else None, self.hold if hold is None else hold) as e:
            _ = e.store
            e._pinned = True
            yield e

    def sync(self) -> Report:
        made, report = sync(self.spark, self.config)
        save(made, self.config.store)
        prune(self.spark, self.config.store)
        return report

    def find(self, name: str) -> Row:
        row, message = lookup.find_or_suggest(self.store.names or self.store.nodes, name)
        if row is None:
            raise NotFound(message)
        return row

    def _reached(self, steps: DataFrame | Walk, start: int, depth: int, cap: int | None) -> DataFrame:
        """The first `cap` nodes in order of discovery, or all. Up to CAP of them are kept on the driver."""
        if cap is not None and cap <= graph.CAP:
            found = graph.with_order(graph.first_reached(steps, start, depth, cap), steps)
            return graph.decorate(found, self.store.nodes, self.store.edges)
        found = graph.all_reached(steps, start, depth)
        return graph.decorate(found if cap is None else found.where(F.col("ord") <= cap), self.store.nodes, self.store.edges, few=False)

    def callers(self, name: str, depth: int = 1, include_weak: bool = False, cap: int | None = graph.CAP) -> DataFrame:
        start, s = self.find(name).id, self.store
        return self._reached(s.steps.upstream(include_weak) if s.steps else graph.upstream_steps(s.edges, include_weak), start, depth, cap)

    def deps(self, name: str, depth: int = 1, include_weak: bool = False, cap: int | None = graph.CAP) -> DataFrame:
        start, s = self.find(name).id, self.store
        return self._reached(s.steps.downstream(include_weak) if s.steps else graph.downstream_steps(s.edges, include_weak), start, depth, cap)

    def impact(self, name: str, depth: int = graph.IMPACT_DEPTH, include_weak: bool = False, cap: int | None = graph.CAP) -> DataFrame:
        start, s = self.find(name).id, self.store
        tables = graph.origin_tables(s.nodes, s.steps or s.edges, start)
        steps = s.steps.impact(include_weak, tables) if s.steps else graph.impact_steps(s.edges, include_weak, graph.origin_column(tables, s.edges))
        return self._reached(steps, start, depth, cap)

    def topic(self, name: str) -> tuple[str, str]:
        """(producers, consumers)."""
        names = self.store.names or self.store.nodes
        row = lookup.first(names, name)
        if row is None or row.kind != "Topic":
            close = lookup.closest(names, name)
            raise NotFound(f"topic not found: {name}" + (f" — closest: {', '.join(close)}" if close else ""))
        ends = graph.topic_ends(self.store.edges, self.store.nodes, row.id).first()
        return ends.producers, ends.consumers

    def bridges(self) -> str:
        return graph.bridge_summary(graph.bridges(self.store.edges, self.store.nodes)).first().summary

    def describe(self, full: bool = False) -> str:
        s = self.store
        out = [render.kind_line(s.nodes)]
        if full:
            first = sorted(graph.samples(s.nodes).collect(), key=lambda r: r.id)
            sample = lambda kind: ", ".join(r.key for r in first if r.kind == kind)
            missing = [r.service for r in lookup.without_dump(s.sql_coverage).orderBy("service").collect()]
            coverage = f"MISSING dictionary dump for [{', '.join(missing)}] — Calls/Touches absent there; an empty impact doesn't mean that nothing depends on it" if missing else "complete"
            out += [f"sample procs: {sample('Procedure')}", f"sample topics: {sample('Topic')}", f"synced: {render.age_of(s.meta)}", f"unresolved topic sites: {s.unresolved.count()}", f"SQL coverage: {coverage}"]
        return "\n".join([*out, f"topic bridges: {self.bridges()}"])

    def symbol(self, name: str, include_path: bool = False) -> str:
        row, s = self.find(name), self.store
        out = f"{row.schema + '.' if row.schema else ''}{row.name} | {row.kind} | schema={row.schema or '-'}"
        if include_path and row.chunk is not None:
            c = s.chunks.where(F.col("id") == row.chunk).select("path", "line_start", "line_end").first()
            out += f" | def {c.path}:{c.line_start}-{c.line_end}"
        ends = s.steps.steps_of(row.id) if s.steps else adjacency.both_ways(s.edges).where(F.col("cur") == row.id)
        d = ends.agg(F.count_if(F.col("dir") == 1).alias("i"), F.count_if(F.col("dir") == 0).alias("o")).first()
        return f"{out} | in={d.i} out={d.o}"

    def chunk(self, name: str, signature_only: bool = True, max_lines: int = 40) -> str:
        row = self.find(name)
        if row.chunk is None:
            return f"{row.schema + '.' if row.schema else ''}{row.name}: no source chunk"
        found = self.store.chunks.where(F.col("id") == row.chunk)
        if signature_only:  # the body's column isn't read
            return found.select("signature").first().signature
        body = lines(F.col("body"))
        c = found.select("path", "line_start", "line_end", F.array_join(F.slice(body, 1, max_lines), "\n").alias("text"), (F.size(body) > max_lines).alias("cut")).first()
        return f"-- {c.path}:{c.line_start}-{c.line_end}\n{c.text}" + ("\n…truncated" if c.cut else "")

    def affected(self, diff: str) -> Affected | None:
        """None if the diff changes no lines."""
        if not diff:
            raise ValueError("no diff given: pipe the output of git diff")
        found = hunks(self.spark, diff)
        return None if found.isEmpty() else self._affected(found)

    def _affected(self, found: DataFrame) -> Affected:
        s = self.store
        return affected(found, s.nodes, s.edges, s.chunks, steps=s.steps.impact() if s.steps else None)

    @staticmethod
    def dictionary_query(schema: str) -> str:
        return dictionary_query(schema)
