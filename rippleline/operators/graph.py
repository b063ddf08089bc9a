"""Bounded-depth traversal of the property graph.

A traversal is a table of steps (cur, nxt, dir, edge_id) and a start. Which steps exist says what it is:
downstream, upstream, or impact with its direction for each kind and its provenance guard. The guard
depends on the start only, so it is a filter of the step table, not a test on the way.

Two executions:

- `first_reached` keeps discovery order and stops at `cap` nodes. All it holds on the driver is at most cap
  nodes; a level is one filter of the step table by the frontier's keys, one partial aggregation, and
  one top-k. Nothing is shuffled but candidate steps of the frontier.
- `all_reached` gives the same order without a cap, and holds nothing of it on the driver.
- `first_reached_of_each` does the same for any number of starts at once, each with its own cap and guard.
- `reach` has no cap and any number of starts. Levels are joins of written tables, whose known sizes let the planner broadcast a small
  frontier and shuffle a large one.

Steps come from a table of edges, or as a Walk over the adjacency that the store keeps (operators/adjacency.py). A Walk is looked up by bucket for a
small frontier, joined without moving it for a large one, and nothing is written for a query but its frontiers.

Discovery order is that of a first-in first-out search that scans a node's outgoing edges by id, then its
incoming ones: within a level, by order of the node it was reached from, direction, edge id.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleline.operators.adjacency import Adjacency, Walk
from rippleline.runtime import bucketed, drop, materialize
from rippleline.schema import impact_forward, is_weak

CAP = 200
IMPACT_DEPTH = 5


def _usable(edges: DataFrame, include_weak: bool) -> DataFrame:
    return edges.where((F.col("src") != F.col("dst")) & (~is_weak(F.col("kind")) | F.lit(include_weak)))


def _steps(edges: DataFrame, forward: Column) -> DataFrame:
    return edges.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("cur"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("nxt"),
        F.when(forward, F.lit(0)).otherwise(F.lit(1)).alias("dir"),
        F.col("id").alias("edge_id"),
    )


def downstream_steps(edges: DataFrame, include_weak: bool = False) -> DataFrame:
    return _steps(_usable(edges, include_weak), F.lit(True))


def upstream_steps(edges: DataFrame, include_weak: bool = False) -> DataFrame:
    return _steps(_usable(edges, include_weak), F.lit(False))


def guard(edges: DataFrame, origin: Column | None) -> DataFrame:
    """Without Publishes edges whose provenance is known and shares nothing with the start's tables. A start
    without tables and an edge without provenance leave it open."""
    if origin is None:
        return edges
    blocked = (F.col("kind") == "Publishes") & (F.size(origin) > 0) & (F.size(F.coalesce("provenance", F.array().cast(edges.schema["provenance"].dataType))) > 0) & ~F.arrays_overlap("provenance", origin)
    return edges.where(~F.coalesce(blocked, F.lit(False)))


def impact_steps(edges: DataFrame, include_weak: bool = False, origin: Column | None = None) -> DataFrame:
    return _steps(guard(_usable(edges, include_weak), origin), impact_forward(F.col("kind")))


def origin_tables(nodes: DataFrame, edges: DataFrame | Adjacency, start: Any, most: int = 10_000) -> list:
    """Tables that a start stands for: itself if a table, what a procedure or function touches directly. From an adjacency, only the start's
    own steps are read."""
    found = nodes.where(F.col("id") == F.lit(start)).select("kind").first()
    if found is None:
        return []
    if found.kind == "Table":
        return [start]
    if found.kind not in ("Procedure", "Function"):
        return []
    if isinstance(edges, Adjacency):
        touched = edges.steps_of(start).where("dir = 0 AND kind = 'Touches'").select(F.col("nxt").alias("dst"))
    else:
        touched = edges.where((F.col("src") == F.lit(start)) & (F.col("kind") == "Touches")).select("dst")
    rows = touched.distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{start} touches more than {most} tables")
    return sorted(r.dst for r in rows)


def origin_column(tables: Sequence, edges: DataFrame) -> Column:
    return F.array(*[F.lit(t) for t in tables]).cast(edges.schema["provenance"].dataType)


def _from_nodes(steps: DataFrame | Walk, nodes: list) -> DataFrame:
    return steps.of(nodes) if isinstance(steps, Walk) else steps.where(F.col("cur").isin(nodes))


def first_reached(steps: DataFrame | Walk, start: Any, max_depth: int, cap: int = CAP) -> list[tuple[Any, Any, int]]:
    """[(node, via edge, depth)] in order of discovery, at most cap; the start itself isn't reported."""
    found: list[tuple[Any, Any, int]] = []
    frontier, seen = [start], [start]
    for depth in range(1, max_depth + 1):
        if not frontier or len(found) >= cap:
            break
        key = steps.schema["cur"].dataType
        place = F.element_at(F.create_map(*[F.lit(x).cast(y) for i, n in enumerate(frontier) for x, y in ((n, key), (i, "int"))]), F.col("cur"))
        level = (
            _from_nodes(steps, frontier).where(~F.col("nxt").isin(seen))
            .groupBy("nxt").agg(F.min(F.struct(place.alias("at"), "dir", "edge_id")).alias("via"))
            .orderBy("via").limit(cap - len(found)).select("nxt", "via.edge_id").collect()
        )
        found += [(r.nxt, r.edge_id, depth) for r in level]
        frontier = [r.nxt for r in level]
        seen += frontier
    return found


def all_reached(steps: DataFrame | Walk, start: Any, max_depth: int) -> DataFrame:
    """first_reached() without a cap, as with_order() has it: (ord, node, via, depth). A node's place in the order of discovery is the list of steps
    that lead to it, so a level is a join and an aggregation, and only numbering puts them in one order."""
    spark, key, via = steps.sparkSession, steps.schema["cur"].dataType, steps.schema["edge_id"].dataType
    way = f"array<struct<dir:int,edge_id:{via.simpleString()}>>"
    level = spark.createDataFrame([(start,)], f"node {key.simpleString()}").select("node", F.array().cast(way).alias("at"), F.lit(0).alias("depth"))
    visited, size = level, 1
    for depth in range(1, max_depth + 1):
        ways = _expanded(steps, level.select("node", "at"), size).select(F.col("nxt").alias("node"), F.concat("at", F.array(F.struct("dir", "edge_id")).cast(way)).alias("at"))
        fresh = ways.join(visited.select("node"), "node", "left_anti").groupBy("node").agg(F.min("at").alias("at"))
        level = materialize(fresh.select("node", "at", F.lit(depth).alias("depth")), "level")
        size = level.count()
        if not size:
            break
        visited = visited.union(level)
    placed = numbered(visited.where("depth > 0"), ["depth", "at"], "ord")
    return placed.select((F.col("ord") + 1).alias("ord"), "node", F.element_at("at", -1)["edge_id"].alias("via"), "depth")


def guarded_steps(edges: DataFrame, include_weak: bool = False) -> DataFrame:
    """impact_steps() with the provenance that a guard asks for, for searches whose starts each have a guard of their own."""
    none = F.array().cast(edges.schema["provenance"].dataType)
    rows = _usable(edges, include_weak)
    forward = impact_forward(F.col("kind"))
    return rows.select(
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("cur"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("nxt"),
        F.when(forward, F.lit(0)).otherwise(F.lit(1)).alias("dir"), F.col("id").alias("edge_id"), F.when(F.col("kind") == "Publishes", F.coalesce("provenance", none)).otherwise(none).alias("needs"),
    )


def origins(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """starts(origin) -> (origin, tables): origin_tables() of each."""
    kind = nodes.select(F.col("id").alias("origin"), "kind").join(starts.select("origin").distinct(), "origin")
    touched = edges.where("kind = 'Touches'").select(F.col("src").alias("origin"), "dst").join(kind.where(F.col("kind").isin("Procedure", "Function")), "origin").groupBy("origin").agg(F.array_sort(F.collect_set("dst")).alias("t"))
    none = F.array().cast(edges.schema["provenance"].dataType)
    found = kind.join(touched, "origin", "left").select("origin", F.when(F.col("kind") == "Table", F.array("origin")).otherwise(F.coalesce("t", none)).alias("tables"))
    return starts.select("origin").distinct().join(found, "origin", "left").select("origin", F.coalesce("tables", none).alias("tables"))


def top_of_each(candidates: DataFrame, cap: int) -> DataFrame:
    """candidates(origin, at, had, ...) with their rank r: the first cap - had of each origin. The bound on r alone is what lets each task keep
    its first `cap` rows before any are moved."""
    ranked = candidates.withColumn("r", F.row_number().over(Window.partitionBy("origin").orderBy("at")))
    return ranked.where(F.col("r") <= cap).where(F.col("r") + F.col("had") <= cap)


def first_reached_of_each(steps: DataFrame | Walk, starts: DataFrame, max_depth: int, cap: int = CAP) -> DataFrame:
    """guarded_steps(), or an unguarded Walk, and (origin, tables) -> (origin, ord, node, via, depth): first_reached() of every origin at once, each
    with its guard and its cap. A level is a join and a top-k an origin, however many origins there are; of an origin's candidates each task
    hands on the first `cap` at most."""
    none = F.lit(None).cast(steps.schema["edge_id"].dataType)
    level = materialize(starts.select("origin", "tables", F.col("origin").alias("node"), F.lit(0).cast("long").alias("ord"), none.alias("via"), F.lit(0).alias("depth")), "level")
    levels, size = [level], level.count()
    for depth in range(1, max_depth + 1):
        visited = functools.reduce(DataFrame.union, levels).select("origin", "node")
        full = visited.groupBy("origin").agg((F.count(F.lit(1)) - 1).alias("had"))
        closed = (F.size("tables") > 0) & (F.size("needs") > 0) & ~F.arrays_overlap("needs", "tables")
        candidates = (
            _expanded(steps, level.select("origin", "tables", "node", "ord"), size).where(~closed)
            .groupBy("origin", "nxt").agg(F.min(F.struct("ord", "dir", "edge_id")).alias("at"), F.first("tables").alias("tables"))
            .withColumnRenamed("nxt", "node").join(visited, ["origin", "node"], "left_anti").join(full, "origin")
        )
        fresh = top_of_each(candidates, cap)
        level = materialize(fresh.select("origin", "tables", "node", (F.col("had") + F.col("r")).alias("ord"), F.col("at.edge_id").alias("via"), F.lit(depth).alias("depth")), "level")
        size = level.count()
        if not size:
            break
        levels.append(level)
    return functools.reduce(DataFrame.union, levels).where("depth > 0").select("origin", "ord", "node", "via", "depth")


def _expanded(steps: DataFrame | Walk, frontier: DataFrame, size: int) -> DataFrame:
    """frontier(node, ...) with the steps from each of its nodes."""
    return steps.join(frontier, size) if isinstance(steps, Walk) else steps.join(frontier, F.col("cur") == F.col("node")).drop("cur")


def laid_out(steps: DataFrame) -> DataFrame:
    """Steps written once, in buckets by where they start: a level's join then moves its frontier, never the steps."""
    return bucketed(steps.select("cur", "nxt"), "cur", "steps")


def reach(steps: DataFrame | Walk, starts: DataFrame, max_depth: int) -> DataFrame:
    """starts(origin, node) -> (origin, node, depth): all that each origin reaches, at its least depth.
    Starts aren't reported for their own origin."""
    if isinstance(steps, Walk):
        step = Walk(steps.rows.select("slot", "cur", "nxt"), steps.hubs)
    else:
        step = laid_out(steps) if max_depth > 1 else steps.select("cur", "nxt")
    frontier = starts.select("origin", "node", F.lit(0).alias("depth")).distinct()
    visited, size = frontier, frontier.count()
    for depth in range(1, max_depth + 1):
        fresh = (
            _expanded(step, frontier.select("origin", "node"), size).select("origin", F.col("nxt").alias("node")).distinct()
            .join(visited.select("origin", "node"), ["origin", "node"], "left_anti")
            .select("origin", "node", F.lit(depth).alias("depth"))
        )
        frontier = materialize(fresh, "frontier")
        size = frontier.count()
        if not size:
            drop(frontier)
            break
        visited = visited.union(frontier)
    if not isinstance(step, Walk):
        drop(step)
    return visited.where("depth > 0")


def with_order(reached: list[tuple[Any, Any, int]], like: DataFrame | Walk) -> DataFrame:
    """first_reached() as a table (ord, node, via, depth)."""
    spark = like.sparkSession
    kind, via = like.schema["cur"].dataType.simpleString(), like.schema["edge_id"].dataType.simpleString()
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(reached)], f"ord long, node {kind}, via {via}, depth int")


def decorate(reached: DataFrame, nodes: DataFrame, edges: DataFrame, few: bool = True) -> DataFrame:
    """What was reached, with the node's key and kind and the edge it was reached by. Where few, reached has at most `cap`
    rows, so it is the side to broadcast."""
    n = nodes.select(F.col("id").alias("node"), F.concat_ws(".", "schema", "name").alias("key"), F.col("name"), F.col("kind").alias("node_kind"))
    e = edges.select(F.col("id").alias("via"), F.col("kind").alias("via_kind"), "path", "line")
    return n.join(F.broadcast(reached) if few else reached, "node").join(e, "via").select("ord", "node", "key", "name", "node_kind", "depth", "via", "via_kind", "path", "line").orderBy("ord")


def bridges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Topics with what is known of them: (topic, name, has_pub, has_con, has_prov)."""
    flags = edges.where(F.col("kind").isin("Publishes", "Consumes")).groupBy(F.col("dst").alias("topic")).agg(
        F.bool_or(F.col("kind") == "Publishes").alias("has_pub"),
        F.bool_or(F.col("kind") == "Consumes").alias("has_con"),
        F.bool_or((F.col("kind") == "Publishes") & (F.size("provenance") > 0)).alias("has_prov"),
    )
    return flags.join(nodes.where("kind = 'Topic'").select(F.col("id").alias("topic"), "name"), "topic")


def bridge_summary(found: DataFrame) -> DataFrame:
    """One row: bridges, guarded, coarse names by node order, and the sentence about them."""
    both = F.col("has_pub") & F.col("has_con")
    names = F.transform(F.array_sort(F.collect_list(F.when(both & ~F.col("has_prov"), F.struct("topic", "name")))), lambda x: x["name"])
    one = found.agg(F.count_if(both).alias("bridges"), F.count_if(both & F.col("has_prov")).alias("guarded"), names.alias("coarse"))
    # The formats of the sentence.
    text = (
        F.when(F.col("bridges") == 0, F.lit("none"))
        .when(F.size("coarse") == 0, F.format_string("%d producer→consumer, all provenance-guarded", "bridges"))
        .otherwise(F.format_string("%d producer→consumer; %d guarded, %d COARSE (impact may over-report consumers — declare [svc.provenance] in topics.toml): [%s]", "bridges", "guarded", F.size("coarse"), F.array_join("coarse", ", ")))
    )
    return one.withColumn("summary", text)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of every node that has an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def topic_ends(edges: DataFrame, nodes: DataFrame, topic: Any) -> DataFrame:
    """One row: producers and consumers of a topic, each "service (path:line)" by edge id."""
    about = edges.where((F.col("dst") == F.lit(topic)) & F.col("kind").isin("Publishes", "Consumes"))
    named = about.join(nodes.select(F.col("id").alias("src"), "name"), "src")
    place = F.struct("id", F.format_string("%s (%s:%d)", "name", "path", "line").alias("text"))
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, place))), lambda x: x["text"]), "; ")
    return named.agg(listed("Publishes").alias("producers"), listed("Consumes").alias("consumers"))


def by_depth(decorated: DataFrame) -> DataFrame:
    """(depth, reached): per depth, what was reached in order of discovery."""
    text = F.struct("ord", F.format_string("%s:%s via:%s", "key", "node_kind", "via_kind").alias("text"))
    return decorated.groupBy("depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda x: x["text"]), "; ").alias("reached")).orderBy("depth")


def rank_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; partial aggregation keeps one row a key and task."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
    return first.select(*keys, *[f"first.{c}" for c in rest])


def numbered(rows: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """rows with ids from 0 in the order of columns that tell them apart. Rows are range-partitioned and sorted where they are; what one task
    sees of all rows is a count a partition."""
    spark, width = rows.sparkSession, 33  # monotonically_increasing_id: the partition above, the row's place in it below
    placed = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(F.shiftright("_at", width).alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = spark.createDataFrame(starts, "_part long, _start long")
    within = F.col("_at") - F.shiftleft("_part", width)
    at = placed.withColumn("_part", F.shiftright("_at", width)).join(F.broadcast(table), "_part")
    return at.select(*rows.columns, (F.col("_start") + within).alias(name))


def dense_ids(rows: DataFrame, key: str, order: str, name: str = "id") -> DataFrame:
    """Ids from 0 by first appearance: (key, id)."""
    first = rows.groupBy(key).agg(F.min(order).alias("_first"))
    return numbered(first, ["_first", key], name).select(key, name)


def samples(nodes: DataFrame, most: int = 5) -> DataFrame:
    """(kind, id, key) of the first nodes of each kind; tasks keep as many each."""
    first = Window.partitionBy("kind").orderBy("id")
    return nodes.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most).select("kind", "id", F.concat_ws(".", "schema", "name").alias("key"))


def kind_line(nodes: DataFrame) -> DataFrame:
    """One row: services, procs, funcs, tables and topics, and the line that says so."""
    kinds = (("services", "Service"), ("procs", "Procedure"), ("funcs", "Function"), ("tables", "Table"), ("topics", "Topic"))
    one = nodes.agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds])
    return one.withColumn("line", F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n, _ in kinds]))
