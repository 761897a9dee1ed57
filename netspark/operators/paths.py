"""Shortest paths, breadth-first search and path trace-back over edge tables.

Edges are undirected rows ``u, v, cost``.  Parallel edges count by their cheapest (``parallel="sum"`` adds them up).
Two forms give the same rows: a heap search per origin in Arrow tasks, over a compact copy of the edges that every
executor holds, while the edges number at most ``BROADCAST_EDGES``; beyond that, rounds of relaxation as joins.
Ties go to the smaller parent.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.plans.iterate import cut

BROADCAST_EDGES = 2_000_000
_PATH = pa.schema([("origin", pa.int64()), ("node", pa.int64()), ("dist", pa.float64()), ("parent", pa.int64()), ("edge", pa.int64())])
_PATH_DDL = "origin long, node long, dist double, parent long, edge long"


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def cheapest(edges: DataFrame, parallel: str = "min") -> DataFrame:
    """One row per unordered pair: u < v, cost, edge (the row it stands for); loops and null ends go."""
    e = edges if "edge" in edges.columns else edges.withColumn("edge", F.lit(None).cast("long"))
    e = e.where("u <> v and cost is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("cost").cast("double").alias("cost"), "edge")
    if parallel == "sum":
        return e.groupBy("u", "v").agg(F.sum("cost").alias("cost"), F.min("edge").alias("edge"))
    best = F.min(F.struct("cost", F.coalesce("edge", F.lit(0)).alias("k"), "edge"))
    return e.groupBy("u", "v").agg(best.alias("b")).select("u", "v", "b.cost", "b.edge")


class Csr:
    """Adjacency in three arrays, nodes numbered densely."""

    def __init__(self, u: np.ndarray, v: np.ndarray, cost: np.ndarray, edge: np.ndarray):
        self.ids = np.unique(np.concatenate([u, v]))
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        tail, head = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((head, tail))
        self.head, self.cost, self.edge = head[order], np.tile(cost, 2)[order], np.tile(edge, 2)[order]
        self.first = np.searchsorted(tail[order], np.arange(len(self.ids) + 1))

    def search(self, origins: list[int], limit: float = np.inf) -> tuple[np.ndarray, ...]:
        """Nodes within ``limit`` (inclusive) of the nearest origin: node, dist, parent, edge by dense numbers."""
        n = len(self.ids)
        dist, parent, via = np.full(n, np.inf), np.full(n, -1), np.full(n, -1)
        heap = []
        for o in origins:
            dist[o] = 0.0
            heap.append((0.0, o))
        heapq.heapify(heap)
        done = np.zeros(n, bool)
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            for k in range(self.first[x], self.first[x + 1]):
                y, e = self.head[k], d + self.cost[k]
                if e <= limit and (e < dist[y] or (e == dist[y] and not done[y] and parent[y] > x)):
                    dist[y], parent[y], via[y] = e, x, self.edge[k]
                    heapq.heappush(heap, (e, y))
        at = np.flatnonzero(np.isfinite(dist))
        return at, dist[at], parent[at], via[at]


def compact(pairs: DataFrame) -> Csr | None:
    """The edges as arrays, or None where they are more than every executor should hold."""
    if pairs.count() > BROADCAST_EDGES:
        return None
    t = pairs.select("u", "v", "cost", F.coalesce("edge", F.lit(-1)).alias("edge")).toPandas()
    return Csr(*(t[c].to_numpy() for c in ("u", "v", "cost", "edge")))


def shortest_paths(edges: DataFrame, origins: DataFrame, limit: float = float("inf"), parallel: str = "min", broadcast: bool | None = None) -> DataFrame:
    """``origin, node, dist, parent, edge`` for each origin (column ``node``) and every node within ``limit``.

    An origin reaches itself at 0 with a null parent.  Origins outside the graph reach themselves only.
    """
    pairs = cut(cheapest(edges, parallel))
    graph = compact(pairs) if broadcast in (None, True) else None
    starts = origins.select(F.col("node").cast("long").alias("node")).where("node is not null").distinct()
    if graph is None:
        first = starts.select(F.col("node").alias("origin"), "node", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge"))
        return _relax(pairs, first, limit)
    shared = origins.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for o in b.column(0).to_pylist():
                k = int(np.searchsorted(g.ids, o))
                if k == len(g.ids) or g.ids[k] != o:
                    yield pa.RecordBatch.from_pylist([{"origin": o, "node": o, "dist": 0.0, "parent": None, "edge": None}], schema=_PATH)
                    continue
                at, dist, parent, via = g.search([k], limit)
                ids = pa.array(g.ids[at])
                up = pa.array(g.ids[np.maximum(parent, 0)], mask=parent < 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), o)), ids, pa.array(dist), up, pa.array(via, mask=via < 0)], schema=_PATH)

    return starts.repartition("node").mapInArrow(run, _PATH_DDL)


def _relax(pairs: DataFrame, first: DataFrame, limit: float, max_rounds: int = 10_000) -> DataFrame:
    """Rounds of relaxation: only rows that improved go on; each round's rows are checkpointed."""
    both = symmetric(pairs)
    best, fresh = cut(first), cut(first)
    for _ in range(max_rounds):
        tried = fresh.select("origin", F.col("node").alias("u"), "dist").join(both, "u")
        tried = tried.select("origin", F.col("v").alias("node"), (F.col("dist") + F.col("cost")).alias("dist"), F.col("u").alias("parent"), "edge")
        tried = tried.where(F.col("dist") <= limit).groupBy("origin", "node").agg(F.min(F.struct("dist", "parent", "edge")).alias("b"))
        old = best.select("origin", "node", F.col("dist").alias("was"), F.col("parent").alias("had"))
        better = (F.col("was").isNull()) | (F.col("b.dist") < F.col("was")) | ((F.col("b.dist") == F.col("was")) & (F.col("b.parent") < F.col("had")))
        fresh = cut(tried.join(old, ["origin", "node"], "left").where(better).select("origin", "node", "b.dist", "b.parent", "b.edge"))
        if fresh.isEmpty():
            return best
        best = cut(best.join(fresh, ["origin", "node"], "left_anti").unionByName(fresh))
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def nearest_source(edges: DataFrame, sources: DataFrame, limit: float = float("inf"), parallel: str = "min") -> DataFrame:
    """Multi-source search: ``node, dist, parent, edge`` from the nearest of the sources (column ``node``)."""
    pairs = cut(cheapest(edges, parallel))
    first = sources.select(F.lit(0).cast("long").alias("origin"), F.col("node").cast("long").alias("node"), F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("edge")).distinct()
    return _relax(pairs, first, limit).drop("origin")


def bfs(links: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``node, depth, parent`` by least number of links; the parent is the smallest one."""
    both = cut(symmetric(links.select("u", "v").where("u <> v")).distinct())
    first = sources.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct()
    seen = fresh = cut(first)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = fresh.select(F.col("node").alias("u")).join(both, "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        fresh = cut(step.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh))
    return seen


def trace(paths: DataFrame, ends: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every step on the way from ``ends`` (keys, node) back to where the parent is null: keys, node, parent, edge."""
    keys = list(keys)
    fresh = cut(ends.select(*keys, "node").distinct().join(paths, [*keys, "node"]).select(*keys, "node", "parent", "edge"))
    out = fresh
    while True:
        up = fresh.where("parent is not null").select(*keys, F.col("parent").alias("node")).distinct()
        fresh = cut(up.join(paths, [*keys, "node"]).select(*keys, "node", "parent", "edge").join(out.select(*keys, "node"), [*keys, "node"], "left_anti"))
        if fresh.isEmpty():
            return out
        out = cut(out.unionByName(fresh))
