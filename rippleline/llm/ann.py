"""Approximate nearest neighbours by an inverted multi-index.

A vector's two halves are quantised separately, so a pair of centroids is a cell. A query visits cells in
order of the summed distance of its halves to the centroids, by a heap over the two sorted
lists, until they hold a `share` of all vectors (and LEAST times k, which matters for the smallest tables). These are reranked by exact
distance. Vectors without structure need a large share for a recall of 0.9; those with clusters a small one.

Centroids are fitted on at most `fit_rows` vectors, chosen by hash; every vector is indexed. Equal
vectors are one entry that keeps its k + 1 smallest ids: no result can need more, so a vector
that is there a million times costs as much as any other. Cell counts are bounded by
centroids^2 and go to every task.

Reranking goes by pairs of blocks: entries of neighbouring cells against queries of neighbouring cells. An entry goes to a block of queries
only if one of them visits the entry's block, and a query to the blocks it visits, with the cells it visits there. A crowded cell is
spread over several blocks. No row is made for a pair of vectors; a pair of blocks gives the k + 1 nearest of each query.

Distances are Euclidean, in double precision, of the vectors as they are (floats are widened, nothing is narrowed). Where squares would
overflow or vanish, differences are scaled first.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another length than
most, take no part; rows are told apart by vec_id and vector, so repeated rows are one, and rows of one vec_id with other vectors are
candidates for each other; rows with null vec_id take no part; ties go to the smaller vec_id; fewer candidates than k give fewer rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rippleline.llm.common import drop, materialize

K, CENTROIDS, SHARE, FIT_ROWS, ROUNDS, LEAST = 10, 256, 0.35, 16384, 10, 4
#: Rows of a block: at least the first, and more once there are so many rows that blocks would be more than BLOCKS; at most the last.
BLOCK, BLOCKS, LARGEST = 1024, 256, 1 << 15
#: Pairs of centroids are taken from the heap in tiles of this side.
TILE = 16


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        held = np.flatnonzero(n)
        if x.shape[1]:
            centres[held] = np.add.reduceat(x[order], (np.cumsum(n) - n)[held]) / n[held, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves, within what can be squared."""
    x = np.clip(x, -1e100, 1e100)
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def counts(held: dict[int, int], cells: int) -> np.ndarray:
    out = np.zeros(cells, np.int64)
    out[list(held)] = list(held.values())
    return out


def visits(q: np.ndarray, first: np.ndarray, second: np.ndarray, held: np.ndarray | dict[int, int], candidates: int) -> list[int]:
    """Cells that hold vectors (held: how many, by cell), in order of summed distance, until they hold enough. The heap holds tiles of pairs of the two sorted
    lists, by their least sum. Once the tiles that were taken hold enough, the sum of the last cell needed is a bound: tiles
    that begin within it are taken too, so no nearer cell is missed."""
    if isinstance(held, dict):
        held = counts(held, len(first) * len(second))
    a, b = halves(q[None])
    d, e = ((first - a) ** 2).sum(1), ((second - b) ** 2).sum(1)
    i, j = np.argsort(d, kind="stable"), np.argsort(e, kind="stable")
    d, e, i = d[i], e[j], i * len(second)
    sums, cells, total, bound = [np.zeros(0)], [np.zeros(0, np.int64)], 0, np.inf
    heap = [(d[0] + e[0], 0, 0)]
    while heap and heap[0][0] <= bound:
        _, x, y = heapq.heappop(heap)
        s, c = d[x : x + TILE, None] + e[y : y + TILE], i[x : x + TILE, None] + j[y : y + TILE]
        n = held[c]
        some = n > 0
        sums.append(s[some])
        cells.append(c[some])
        total += int(n.sum())
        if bound == np.inf and total >= candidates:
            s, n = np.concatenate(sums), held[np.concatenate(cells)]
            order = np.argsort(s, kind="stable")
            bound = s[order[np.searchsorted(np.cumsum(n[order]), candidates)]]
        if y + TILE < len(e):
            heapq.heappush(heap, (d[x] + e[y + TILE], x, y + TILE))
        if y == 0 and x + TILE < len(d):  # each tile is reached from one side only
            heapq.heappush(heap, (d[x + TILE] + e[0], x + TILE, 0))
    s, c = np.concatenate(sums), np.concatenate(cells)
    c = c[np.argsort(s, kind="stable")]
    return c[: int(np.searchsorted(np.cumsum(held[c]), candidates)) + 1].tolist()


def layout(held: dict[int, int], cells: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and over how many blocks it is spread."""
    first, spread, block, full = np.zeros(cells, np.int32), np.ones(cells, np.int32), 0, 0
    for cell in sorted(held):
        n = held[cell]
        if full and full + n > size:
            block, full = block + 1, 0
        first[cell], spread[cell] = block, max(1, -(-n // size))
        full += n
        if spread[cell] > 1:
            block, full = block + int(spread[cell]), 0
    return first, spread


def block_size(rows: int) -> int:
    return min(LARGEST, max(BLOCK, -(-rows // BLOCKS)))


def distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distance of q to each row of v."""
    with np.errstate(over="ignore", under="ignore"):
        diff = v - q
        plain = np.sqrt((diff**2).sum(1))
        odd = np.flatnonzero(~np.isfinite(plain) | (plain < 1e-140))
        if len(odd):
            top = np.abs(diff[odd]).max(1)
            scale = np.where((top > 0) & np.isfinite(top), top, 1.0)
            plain[odd] = scale * np.sqrt(((diff[odd] / scale[:, None]) ** 2).sum(1))
    return plain


def rerank(q: np.ndarray, cells: list[np.ndarray], v: np.ndarray, cell: np.ndarray, least: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query, entry, distance) of the k nearest entries in visited cells, smaller ids first among equals. A product of matrices
    sifts; what it leaves is measured exactly."""
    scale = max(np.abs(q).max(), np.abs(v).max())
    a, b = q / scale, v / scale
    near = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    slack, out = 1e-9 * q.shape[1], []
    known, code = np.unique(cell, return_inverse=True)
    for i, row in enumerate(near):
        at = np.minimum(np.searchsorted(known, cells[i]), len(known) - 1)
        visited = np.zeros(len(known), bool)
        visited[at[known[at] == cells[i]]] = True
        seen = np.flatnonzero(visited[code])
        if len(seen) > k:
            seen = seen[row[seen] <= np.partition(row[seen], k - 1)[k - 1] + slack]
        exact = distances(q[i], v[seen])
        order = np.lexsort((least[seen], exact))[:k]
        out += [(i, int(seen[j]), float(exact[j])) for j in order]
    return out


def search(vectors: DataFrame, is_query: Column, k: int = K, centroids: int = CENTROIDS, share: float = SHARE, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("v").toPandas()["v"].tolist()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(x) for x in sample]
    dim = max(sorted(set(lengths)), key=lengths.count)
    fit = np.array([x for x in sample if len(x) == dim], np.float64)
    first, second = (kmeans(h, centroids, ROUNDS) for h in halves(fit))
    cells = len(first) * len(second)

    def cell_of(v: pd.Series) -> np.ndarray:
        a, b = halves(np.array(v.tolist(), np.float64).reshape(-1, dim))
        return (nearest(a, first) * len(second) + nearest(b, second)).astype(np.int32)

    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cell_of(v))

    fine = fine.where(F.size("v") == dim).distinct()
    numbered = fine.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = numbered.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(classes.select("v", "ids", cell("v").alias("cell")), "entries")
    asked = materialize(fine.where(is_query).select("vec_id", "v"), "asked")
    wanted = materialize(asked.select(F.col("v").alias("q")).distinct().select(F.monotonically_increasing_id().alias("n"), "q", cell("q").alias("cell")), "wanted")
    # At most centroids^2 rows each.
    held, asking = (dict(tuple(r) for r in t.groupBy("cell").count().collect()) for t in (entries, wanted))
    n, n_asked = sum(held.values()), sum(asking.values())
    place, spread = layout(held, cells, block_size(n))
    part, parts = layout(asking, cells, block_size(n_asked))
    enough = max(LEAST * k, int(np.ceil(share * n)))
    filled = counts(held, cells)

    @F.pandas_udf("array<struct<block int, cells binary>>")
    def visit(vs: pd.Series) -> pd.Series:
        rows = []
        for v in vs:
            at = np.sort(np.array(visits(np.asarray(v, np.float64), first, second, filled, enough), "<i4"))
            # Places follow cells, so cells of one block are neighbours; a cell that is spread has its blocks to itself.
            alone = at[spread[at] > 1]
            at = at[spread[at] == 1]
            runs = np.split(at, np.flatnonzero(np.diff(place[at])) + 1) if len(at) else []
            row = [{"block": int(place[x[0]]), "cells": x.tobytes()} for x in runs]
            rows.append(row + [{"block": int(place[c]) + i, "cells": c.tobytes()} for c in alone for i in range(spread[c])])
        return pd.Series(rows)

    def dealt(base: np.ndarray, over: np.ndarray, column: str) -> Column:
        @F.pandas_udf(T.IntegerType())
        def block(c: pd.Series, salt: pd.Series) -> pd.Series:
            return pd.Series((base[c.to_numpy()] + salt.to_numpy() % over[c.to_numpy()]).astype(np.int32))

        return block("cell", F.pmod(F.xxhash64(column), F.lit(1 << 30)))

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["n", "ids", "score", "own"]
        if left.empty or right.empty:
            return pd.DataFrame({x: [] for x in names})
        q, v = (np.stack(x.to_list()).astype(np.float64) for x in (left["q"], right["v"]))
        visited = [np.frombuffer(x, "<i4") for x in left["cells"]]
        found = rerank(q, visited, v, right["cell"].to_numpy(), np.array([x[0] for x in right["ids"]]), k + 1)
        i, j = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
        return pd.DataFrame({"n": left["n"].iloc[i].tolist(), "ids": right["ids"].iloc[j].tolist(), "score": [x[2] for x in found], "own": (q[i] == v[j]).all(1)}, columns=names)

    # Visits take some hundredths of a second each, so queries are dealt out evenly, however few bytes they are.
    routed = wanted.select("n", "q", dealt(part, parts, "q").alias("part")).repartition(partitions, "n").withColumn("at", F.explode(visit("q")))
    left = materialize(routed.select("n", "q", "part", "at.block", "at.cells"), "visits")
    pairs = left.select(F.col("part").alias("_part"), F.col("block").alias("_block")).distinct()
    right = entries.select("v", "ids", "cell", dealt(place, spread, "v").alias("at")).join(pairs, F.col("at") == F.col("_block")).select("v", "ids", "cell", "_part", "_block")
    near = left.groupBy("part", "block").cogroup(right.groupBy("_part", "_block")).applyInPandas(compare, "n long, ids array<long>, score double, own boolean")
    closest = Window.partitionBy("n").orderBy("score", F.col("ids")[0])
    near = near.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= k + 1)
    results = materialize(near.groupBy("n").agg(F.collect_list(F.struct("score", "ids", "own")).alias("near")), "nearest")  # k + 1 each
    drop(entries, left)
    each = F.flatten(F.transform("near", lambda x: F.transform(x["ids"], lambda i: F.struct(x["score"].alias("score"), i.alias("vec_id"), x["own"].alias("own")))))
    mine = asked.withColumnRenamed("vec_id", "query_id").join(wanted.select("n", "q"), F.col("v") == F.col("q")).join(results.select("n", each.alias("near")), "n")
    others = F.slice(F.array_sort(F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id"))))), 1, k)
    return mine.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
