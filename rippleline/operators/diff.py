"""From a unified diff to changed symbols and what they affect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.operators import graph
from rippleline.operators.adjacency import Walk
from rippleline.operators.graph import CAP, IMPACT_DEPTH, rank_first
from rippleline.runtime import materialize

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def hunks(spark: SparkSession, diff: str) -> DataFrame:
    """(pos, file, start, end): new-side ranges. A deleted file has none; a header without a count means one line. Lines that a
    hunk's counts cover are its text, even if they look like headers."""
    rows, file, left_old, left_new = [], None, 0, 0
    for line in diff.splitlines():
        if left_old > 0 or left_new > 0:
            left_old -= line[:1] in ("-", " ", "")
            left_new -= line[:1] in ("+", " ", "")
            continue
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            file = None if name == "/dev/null" else name.removeprefix("b/").removeprefix("./")
        elif line.startswith("diff "):
            file = None
        elif (m := _HUNK.match(line)) and file is not None:
            count = int(m[4]) if m[4] is not None else 1
            rows.append((len(rows), file, int(m[3]), int(m[3]) + max(count, 1) - 1))
        if m := _HUNK.match(line):
            left_old, left_new = (int(m[i]) if m[i] is not None else 1 for i in (2, 4))
    return spark.createDataFrame(rows, "pos int, file string, start int, end int")


def _same_path(stored, wanted):
    return stored.endswith(wanted) | wanted.endswith(stored)


#: Characters of a path's end that two paths share if one ends with the other and both are as long; lines of a bin.
TAIL, BIN = 24, 256


def _ends(path: Column) -> Column:
    """The keys that a path is filed under: its base name, and the end of a long one."""
    base = F.struct(F.lit(False).alias("long"), F.element_at(F.split(path, "/"), -1).alias("end"))
    return F.when(F.length(path) < TAIL, F.array(base)).otherwise(F.array(base, F.struct(F.lit(True).alias("long"), F.right(path, F.lit(TAIL)).alias("end"))))


def _bins(first: Column, last: Column) -> Column:
    return F.sequence(F.floor(first / BIN), F.floor(F.greatest(first, last) / BIN))


def _on_same_path(stored: DataFrame, found: DataFrame, by_line: bool) -> DataFrame:
    """Pairs of stored(path as `stored`) and hunks(file) where one path ends with the other; by line, only those whose lines overlap.

    An equi-join: two long paths meet on the end they must share, so files of one common name don't all meet; a short path meets others on its
    base name. With lines, both sides are filed under bins of lines, and a pair counts in the first bin that both are in. Neither side is broadcast
    unless the planner knows it to be small."""
    left = stored.withColumn("_key", F.explode(_ends(F.col("stored")))).select("*", "_key.long", "_key.end").drop("_key")
    right = found.select("pos", "file", "start", F.col("end").alias("until"), F.explode(_ends(F.col("file"))).alias("_key")).select("*", "_key.long", "_key.end").drop("_key")
    keys = ["long", "end"]
    both = (F.length("stored") >= TAIL) & (F.length("file") >= TAIL)
    kept = _same_path(F.col("stored"), F.col("file")) & (F.col("long") == both)
    if by_line:
        left = left.withColumn("bin", F.explode(_bins(F.col("line_start"), F.col("line_end"))))
        right = right.withColumn("bin", F.explode(_bins(F.col("start"), F.col("until"))))
        keys.append("bin")
        kept &= (F.col("until") >= F.col("line_start")) & (F.col("start") <= F.col("line_end")) & (F.col("bin") == F.greatest(F.floor(F.col("line_start") / BIN), F.floor(F.col("start") / BIN)))
    return left.join(right, keys).where(kept).drop("long", "end", "bin").withColumnRenamed("until", "end")


def changed_symbols(found: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ord, node, name, kind, file, lines, source): definitions that a hunk overlaps, and what edges of a changed file start
    from."""
    c = chunks.where("node is not null").select("node", F.col("id").alias("evidence"), F.col("path").alias("stored"), "line_start", "line_end")
    by_chunk = _on_same_path(c, found, True)
    e = edges.where("kind <> 'Owns'").select(F.col("src").alias("node"), F.col("id").alias("evidence"), F.col("path").alias("stored"))
    by_edge = _on_same_path(e, found, False)
    rows = None
    for rank, (part, source) in enumerate(((by_chunk, "chunk overlap"), (by_edge, "edge path"))):
        some = part.select("node", F.col("stored").alias("file"), F.format_string("%d-%d", "start", "end").alias("lines"), F.lit(source).alias("source"), F.struct("pos", F.lit(rank).alias("rank"), "evidence").alias("at"))
        rows = some if rows is None else rows.union(some)
    first = rank_first(rows, ["node"], ["at"])
    named = first.join(nodes.select(F.col("id").alias("node"), F.concat_ws(".", "schema", "name").alias("name"), "kind"), "node")
    return named.orderBy("at").select("at", "node", "name", "kind", "file", "lines", "source")


@dataclass(frozen=True)
class Affected:
    changed: list[dict]
    blast_radius: list[dict]
    cross_service: list[str]


def blast_radius(changed: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = IMPACT_DEPTH, cap: int = CAP, steps: Walk | None = None) -> DataFrame:
    """(at, node, name, kind, depth, cross): what changed symbols reach, each search capped and guarded as a single one is, in order of first
    occurrence; cross says that it is a service that didn't change itself. All searches run as one, level by level."""
    starts = changed.select(F.col("node").alias("origin"), F.col("at").alias("place"))
    found = graph.first_reached_of_each(steps or graph.guarded_steps(edges), graph.origins(nodes, edges, starts), depth, cap)
    first = found.join(starts, "origin").groupBy("node").agg(F.min(F.struct("place", "ord", "depth")).alias("at"))
    named = first.join(nodes.select(F.col("id").alias("node"), "name", "kind"), "node").join(starts.select(F.col("origin").alias("node"), F.lit(True).alias("own")), "node", "left")
    return named.select("at", "node", "name", "kind", F.col("at.depth").alias("depth"), ((F.col("kind") == "Service") & F.col("own").isNull()).alias("cross"))


def affected(found: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, depth: int = IMPACT_DEPTH, steps: Walk | None = None) -> Affected:
    """The report of a diff: at most `cap` rows for each changed symbol, so it is put together on the driver."""
    changed = materialize(changed_symbols(found, nodes, edges, chunks), "changed")
    rows = blast_radius(changed, nodes, edges, depth, steps=steps).orderBy("at").collect()
    blast = [{"name": r.name, "kind": r.kind, "depth": r.depth} for r in rows]
    listed = [{k: c[k] for k in ("name", "kind", "file", "lines", "source")} for c in changed.orderBy("at").collect()]
    return Affected(listed, blast, [r.name for r in rows if r.cross])
