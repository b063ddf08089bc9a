"""Reports as text: what the command line and the tools print."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rippleline.functions.text import age
from rippleline.operators import graph
from rippleline.operators.diff import Affected


def _short(path: str) -> str:
    return "/".join(path.split("/")[-3:])


def reached_lines(rows: Iterable[Row], most: int | None = None) -> str:
    """One line a node: name:Kind via:Edge (path:line)."""
    rows = list(rows)[:most]
    return "\n".join(f"{r.key}:{r.node_kind} via:{r.via_kind} ({r.path}:{r.line})" for r in rows) or "(none)"


def impact_lines(rows: Sequence[Row], most: int | None = None, cap: int = graph.CAP) -> str:
    """One line a depth; a note if the search was cut off, unless no more was asked for than it found."""
    if not rows:
        return "(none)"
    shown: dict[int, list[str]] = {}
    for r in rows[:most]:
        shown.setdefault(r.depth, []).append(f"{r.key}:{r.node_kind} via:{r.via_kind}")
    out = [f"d{d}: [{'; '.join(x)}]" for d, x in sorted(shown.items())]
    if len(rows) >= cap and (most is None or most >= cap):
        out.append("(cap hit) narrow: lower depth or include_weak=false")
    return "\n".join(out)


def affected_md(report: Affected) -> str:
    out = ["## Changed symbols", "| file | symbol | kind | lines | source |", "|---|---|---|---|---|"]
    out += [f"| {_short(c['file'])} | {c['name']} | {c['kind']} | {c['lines']} | {c['source']} |" for c in report.changed]
    if report.blast_radius:
        out += ["", f"## Blast radius ({len(report.blast_radius)} nodes)", "| symbol | kind | depth |", "|---|---|---|"]
        out += [f"| {b['name']} | {b['kind']} | d{b['depth']} |" for b in report.blast_radius]
    else:
        out += ["", "(no impact beyond changed symbols)"]
    if report.cross_service:
        out += ["", "## Cross-service impact", *(f"- {s}" for s in report.cross_service)]
    return "\n".join(out) + "\n"


def affected_json(report: Affected) -> str:
    return json.dumps({"changed": report.changed, "blast_radius": report.blast_radius, "cross_service": report.cross_service}, ensure_ascii=False)


def kind_line(nodes: DataFrame) -> str:
    return graph.kind_line(nodes).first().line


def age_of(meta: DataFrame) -> str:
    row = meta.select(F.when(F.col("synced_at") == 0, "unknown").otherwise(age(F.greatest(F.unix_timestamp() - F.col("synced_at"), F.lit(0)))).alias("age")).first()
    return row.age
