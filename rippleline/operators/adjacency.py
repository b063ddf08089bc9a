"""Adjacency, written once for each version of a graph: what leads on from a node, in both directions.

A row is a step (slot, cur, nxt, dir, edge_id, kind, needs): dir 0 along an edge, 1 against it. The table is bucketed and sorted by slot, a hash
of `cur`; so a question about a few nodes reads the row groups of their buckets, and a join with a large frontier moves the frontier, not the
steps. A node with more steps than HUB has several slots, dealt by edge, and is listed in a table of hubs with their number; no bucket grows with one
node. The frontier's rows at a hub are repeated for its slots, which are as many as its steps divided by HUB.

A walk says which rows count: downstream, upstream, or impact with its direction for each kind and its guard.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleline.schema import impact_forward, is_weak

HUB = 1 << 17
STEP = ("cur", "nxt", "dir", "edge_id", "kind", "needs")
#: A frontier of so many slots is looked up instead of joined.
SEEK = 400


def _slot(node: Column, part: Column) -> Column:
    return F.xxhash64(node, part)


@dataclass(frozen=True)
class Walk:
    """Steps of some adjacency that a traversal may take."""

    rows: DataFrame
    hubs: DataFrame | None

    @property
    def schema(self):
        return self.rows.schema

    @property
    def sparkSession(self) -> SparkSession:
        return self.rows.sparkSession

    def of(self, nodes: Sequence[Any]) -> DataFrame:
        """The steps that start from a few nodes; other buckets aren't read."""
        key = self.schema["cur"].dataType
        parts = {n: 1 for n in nodes}
        if self.hubs is not None:
            parts |= {r.cur: r.parts for r in self.hubs.where(F.col("cur").isin(list(nodes))).collect()}
        slots = [_slot(F.lit(n).cast(key), F.lit(i)) for n, k in parts.items() for i in range(k)]
        return self.rows.where(F.col("slot").isin(slots) & F.col("cur").isin(list(nodes))) if slots else self.rows.where(F.lit(False))

    def join(self, frontier: DataFrame, size: int) -> DataFrame:
        """frontier(node, ...) with the steps from each of its nodes. size: its rows; if few, their slots are looked up."""
        part = F.lit(0)
        if self.hubs is not None:
            many = self.hubs.withColumnRenamed("cur", "_hub")
            frontier = frontier.join(many, F.col("node") == F.col("_hub"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("_hub", "parts")
            part = F.col("_part")
        placed, rows = frontier.withColumn("_slot", _slot(F.col("node"), part)).drop("_part"), self.rows
        if size <= SEEK:
            slots = [r[0] for r in placed.select("_slot").distinct().limit(SEEK + 1).collect()]
            if len(slots) <= SEEK:
                rows = rows.where(F.col("slot").isin(slots))
        # Nodes are compared by two bounds: as a key of the join it would ask for another partitioning than that of the buckets.
        same = (F.col("node") >= F.col("cur")) & (F.col("node") <= F.col("cur"))
        return placed.join(rows, (F.col("_slot") == F.col("slot")) & same).drop("_slot", "slot", "cur")


@dataclass(frozen=True)
class Adjacency:
    rows: DataFrame
    hubs: DataFrame | None
    table: str

    def _walk(self, chosen: Column, include_weak: bool) -> Walk:
        strong = F.lit(True) if include_weak else ~is_weak(F.col("kind"))
        return Walk(self.rows.where(chosen & strong), self.hubs)

    def downstream(self, include_weak: bool = False) -> Walk:
        return self._walk(F.col("dir") == 0, include_weak)

    def upstream(self, include_weak: bool = False) -> Walk:
        return self._walk(F.col("dir") == 1, include_weak)

    def impact(self, include_weak: bool = False, origin: Sequence[Any] = ()) -> Walk:
        """Along edges of kinds whose impact goes forward, against all others. A step that needs other tables than the origin's is shut;
        an origin without tables and a step without needs leave it open."""
        along = F.when(impact_forward(F.col("kind")), F.col("dir") == 0).otherwise(F.col("dir") == 1)
        if origin:
            tables = F.array(*[F.lit(t) for t in origin]).cast(self.rows.schema["needs"].dataType)
            along &= (F.size("needs") == 0) | F.arrays_overlap("needs", tables)
        return self._walk(along, include_weak)

    def steps_of(self, node: Any) -> DataFrame:
        """All steps from one node, of any kind and direction."""
        return Walk(self.rows, self.hubs).of([node])

    def close(self) -> None:
        """Forget the table's name; its files belong to the store."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def both_ways(edges: DataFrame) -> DataFrame:
    """(cur, nxt, dir, edge_id, kind, needs): each edge from either end."""
    none = F.array().cast(edges.schema["provenance"].dataType)
    ends = F.array(F.struct(F.col("src").alias("cur"), F.col("dst").alias("nxt"), F.lit(0).alias("dir")), F.struct(F.col("dst").alias("cur"), F.col("src").alias("nxt"), F.lit(1).alias("dir")))
    needs = F.when(F.col("kind") == "Publishes", F.coalesce("provenance", none)).otherwise(none)
    return edges.where("src <> dst").select(F.explode(ends).alias("s"), F.col("id").alias("edge_id"), "kind", needs.alias("needs")).select("s.*", "edge_id", "kind", "needs")


def named(rows: DataFrame) -> DataFrame:
    """Steps with the ids of edges that are named by kind and ends, kind|src|dst."""
    along = F.col("dir") == 0
    return rows.withColumn("edge_id", F.concat_ws("|", "kind", F.when(along, F.col("cur")).otherwise(F.col("nxt")), F.when(along, F.col("nxt")).otherwise(F.col("cur"))))


def write(edges: DataFrame, path: str, hub: int = HUB, by_ends: bool = False) -> None:
    """Write the adjacency of edges(id, src, dst, kind, provenance) below a path. Where edges are named by kind and ends, ids are neither moved nor
    written, but made anew of what is read."""
    spark, both = edges.sparkSession, both_ways(edges)
    if by_ends:
        both = both.drop("edge_id")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both.groupBy("cur").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).where("parts > 1").write.parquet(f"{path}/hubs")
    hubs = spark.read.parquet(f"{path}/hubs")
    n = hubs.count()
    part = F.lit(0)
    if n:
        both = both.join(hubs.withColumnRenamed("cur", "_hub"), F.col("cur") == F.col("_hub"), "left")
        part = F.pmod(F.xxhash64("kind", "nxt") if by_ends else F.xxhash64("edge_id"), F.coalesce("parts", F.lit(1))).cast("int")
    # The slot is made again where the rows arrive: a hash doesn't compress, and would be a fifth of what is moved.
    columns = [c for c in STEP if c in both.columns]
    placed = both.select(*columns, part.alias("_part"))
    name = f"rippleline_writing_{uuid.uuid4().hex}"
    slot = _slot(F.col("cur"), F.col("_part"))
    dealt = placed.repartition(buckets, slot).select(slot.alias("slot"), *columns)
    dealt.write.bucketBy(buckets, "slot").sortBy("slot").option("compression", "zstd").option("path", f"{path}/steps").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    spark.createDataFrame([(buckets, n)], "buckets int, hubs long").coalesce(1).write.parquet(f"{path}/shape")


def read(spark: SparkSession, path: str) -> Adjacency:
    """An adjacency that was written, in this session or another."""
    shape = spark.read.parquet(f"{path}/shape").first()
    plain = spark.read.parquet(f"{path}/steps")
    name = f"rippleline_steps_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {shape.buckets} BUCKETS LOCATION '{place}/steps'")
    rows = spark.table(name)
    return Adjacency(rows if "edge_id" in rows.columns else named(rows), spark.read.parquet(f"{path}/hubs") if shape.hubs else None, name)
