"""Searches over a grid of tiles: the tile graph, lower bounds, frontier, goal-directed search, rounds."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.operators.network import dense_ids
from netspark.operators.paths import bfs, symmetric, trace
from netspark.plans.iterate import cut

PACK, MOST_GOALS = 100_000, 100_000


def cell_id(ix, iy) -> Column:
    return F.col(ix).cast("long") * PACK + F.col(iy)


def cell_xy(cell: str) -> tuple[Column, Column]:
    return F.floor(F.col(cell) / PACK).cast("long"), F.pmod(F.col(cell), F.lit(PACK)).cast("long")


def chebyshev(a: str, b: str) -> Column:
    (ax, ay), (bx, by) = cell_xy(a), cell_xy(b)
    return F.greatest(F.abs(ax - bx), F.abs(ay - by))


def tile_graph(vertices: DataFrame, size: float, groups: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells with the length that falls to them, and links of consecutive cells along a line.

    ``vertices``: line, ord, x, y, grp.  A segment's length goes to the cell of its second vertex.
    """
    v = vertices if groups is None else vertices.where(F.col("grp").isin(groups))
    v = v.withColumn("cell", F.floor(F.col("x") / size).cast("long") * PACK + F.floor(F.col("y") / size).cast("long"))
    w = Window.partitionBy("line").orderBy("ord")
    v = v.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pc": F.lag("cell").over(w)})
    length = F.coalesce(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")), F.lit(0.0))
    cells = v.groupBy("cell").agg(F.sum(length).alias("length_m"))
    links = v.where("pc <> cell").select(F.least("pc", "cell").alias("u"), F.greatest("pc", "cell").alias("v")).distinct()
    return cells, links


def lower_bound(links: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells on shortest ways (fewest links, smallest parents) from the starts to every reachable target."""
    tree = bfs(links, starts).withColumn("edge", F.lit(None).cast("long"))
    return trace(tree, targets).select("node").distinct()


def exits(lines: DataFrame, tiles: DataFrame, near: float = 20.0) -> DataFrame:
    """``tile_id, side``: sides of a tile within ``near`` of which a line ends."""
    from netspark.functions import geometry as G

    ends = lines.select("tile_id", F.explode(F.array(G.start("geom"), G.end("geom"))).alias("p")).join(tiles, "tile_id")
    hit = {"w": F.expr("abs(p.x - xmin)"), "e": F.expr("abs(p.x - xmax)"), "s": F.expr("abs(p.y - ymin)"), "n": F.expr("abs(p.y - ymax)")}
    sides = F.array(*(F.when(d <= near, F.lit(k)) for k, d in hit.items()))
    return ends.select("tile_id", F.explode(F.array_compact(sides)).alias("side")).distinct()


def frontier(found: DataFrame, attempted: DataFrame) -> DataFrame:
    """Neighbour cells that an exit of a read cell (ix, iy, side) leads to and that nobody attempted (ix, iy)."""
    dx = F.when(F.col("side") == "e", 1).when(F.col("side") == "w", -1).otherwise(0)
    dy = F.when(F.col("side") == "n", 1).when(F.col("side") == "s", -1).otherwise(0)
    to = found.select((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy")).distinct()
    return to.join(attempted.select("ix", "iy"), ["ix", "iy"], "left_anti")


def choose(frontier_: DataFrame, goals: DataFrame, k: int, most: int = MOST_GOALS) -> DataFrame:
    """The k frontier cells (ix, iy) nearest to a goal (Chebyshev), by distance and then cell: ix, iy, dist.

    Up to ``most`` goals are held by every task; beyond that cells look for goals in squares that grow until all have one.
    """
    g = goals.select(F.col("ix").alias("gx"), F.col("iy").alias("gy")).distinct()
    far = F.greatest(F.abs(F.col("ix") - F.col("gx")), F.abs(F.col("iy") - F.col("gy")))
    n = g.count()
    if n <= most:
        near = frontier_.join(F.broadcast(g), F.lit(True)).groupBy("ix", "iy").agg(F.min(far).alias("dist"))
        return near.orderBy("dist", "ix", "iy").limit(k)
    g, left, found, r = cut(g), cut(frontier_.select("ix", "iy").distinct()), None, 16
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while not left.isEmpty():
        square = lambda c: F.floor(F.col(c) / r).cast("long")  # noqa: B023, E731
        around = g.select("gx", "gy", square("gx").alias("sx"), square("gy").alias("sy"))
        asked = left.select("ix", "iy", square("ix").alias("x0"), square("iy").alias("y0")).select("*", step.alias("dx")).select("*", step.alias("dy"))
        asked = asked.select("ix", "iy", (F.col("x0") + F.col("dx")).alias("sx"), (F.col("y0") + F.col("dy")).alias("sy"))
        hit = cut(asked.join(around, ["sx", "sy"]).groupBy("ix", "iy").agg(F.min(far).alias("dist")).where(F.col("dist") <= r))
        found = hit if found is None else cut(found.unionByName(hit))
        left, r = cut(left.join(hit, ["ix", "iy"], "left_anti")), r * 4
        if found.count() >= k and not left.isEmpty():
            break  # all that are left lie further off than those found
    return found.orderBy("dist", "ix", "iy").limit(k)


def connected(links: DataFrame, read: DataFrame, start: DataFrame) -> DataFrame:
    """Read cells that are reachable from the start over links between read cells."""
    both = symmetric(links.select("u", "v"))
    inside = both.join(read.select(F.col("node").alias("u")), "u", "left_semi").join(read.select(F.col("node").alias("v")), "v", "left_semi")
    return bfs(inside, start.join(read.select("node"), "node", "left_semi")).select("node", "depth")


def search_rounds(start: DataFrame, goals: DataFrame, read: Callable[[DataFrame], DataFrame], per_round: int = 12, cap: int = 600) -> tuple[DataFrame, list[int]]:
    """Outward search: each round reads the ``per_round`` frontier cells nearest to the goals.

    ``read`` takes cells (ix, iy) and returns their exits (ix, iy, side); it stands for the model.  Ends when there is
    no frontier or ``cap`` cells are read; returns the exits found and the size of every round.
    """
    attempted = cut(start.select("ix", "iy").distinct())
    found, sizes, n = cut(read(attempted)), [attempted.count()], attempted.count()
    while n < cap:
        todo = cut(choose(frontier(found, attempted), goals, min(per_round, cap - n)).select("ix", "iy"))
        size = todo.count()
        if not size:
            break
        found = cut(found.unionByName(read(todo)))
        attempted = cut(attempted.unionByName(todo))
        sizes.append(size)
        n += size
    return found, sizes


def goal_directed(links: DataFrame, starts: DataFrame, targets: DataFrame, by: str = "region", seed_radius: int = 3, most: int = 50_000) -> DataFrame:
    """Cells read by a goal-directed search, per region: ``region, cell, reached`` (reached: a target that was got).

    Targets (region, cell, depth) are taken by depth and cell; each search starts from the read cells within
    ``seed_radius`` rings of the nearest one and reads what it takes from its queue, at most ``most`` cells.  What one
    search reads helps the next, so a region is one task; regions run side by side.
    """

    def run(key, edges: pd.DataFrame, roles: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for u, v in zip(edges["u"], edges["v"]):
            near.setdefault(u, []).append(v)
            near.setdefault(v, []).append(u)
        far = lambda a, b: max(abs(a // PACK - b // PACK), abs(a % PACK - b % PACK))
        read = {c for c in roles.loc[roles["role"] == 0, "cell"] if c in near}
        got = set()
        wanted = roles[roles["role"] == 1].sort_values(["depth", "cell"], na_position="last")["cell"]
        for goal in wanted:
            if goal in read:
                got.add(goal)
                continue
            away = {c: far(c, goal) for c in read}
            ring = min(away.values(), default=0)
            cost = {c: 0 for c, d in away.items() if d <= ring + seed_radius}
            queue = [(away[c], 0, c) for c in cost]
            heapq.heapify(queue)
            taken = 0
            while queue and taken < most:
                _, g, c = heapq.heappop(queue)
                if g > cost[c]:
                    continue
                taken += 1
                read.add(c)
                if c == goal:
                    got.add(goal)
                    break
                for d in near.get(c, ()):
                    if g + 1 < cost.get(d, 1 << 60):
                        cost[d] = g + 1
                        heapq.heappush(queue, (g + 1 + far(d, goal), g + 1, d))
        return pd.DataFrame({by: key[0], "cell": sorted(read), "reached": [c in got for c in sorted(read)]})

    roles = starts.select(by, "cell", F.lit(None).cast("long").alias("depth"), F.lit(0).alias("role")).unionByName(targets.select(by, "cell", F.col("depth").cast("long").alias("depth"), F.lit(1).alias("role")))
    kind = dict(links.dtypes)[by]
    return links.select(by, "u", "v").groupBy(by).cogroup(roles.groupBy(by)).applyInPandas(run, f"{by} {kind}, cell long, reached boolean")


def batches(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """``batch``: 0, 1, 2 ... for each n rows in order (which must tell all rows apart); no task holds all rows."""
    numbered = dense_ids(rows.select(F.struct(*order).alias("node")))
    numbered = numbered.select(*(F.col(f"node.{c}").alias(c) for c in order), F.floor(F.col("id") / n).cast("long").alias("batch"))
    return rows.join(numbered, order)


def dead_ends(edges: DataFrame) -> DataFrame:
    return symmetric(edges.select("u", "v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree")).where("degree = 1").select("node")


def spaced(rows: DataFrame, key: str, order: list[str], apart: float) -> DataFrame:
    """Per key, points (x, y) in order that lie at least ``apart`` from all kept before them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        kept: list[tuple[float, float]] = []
        use = []
        for x, y in zip(g["x"], g["y"]):
            use.append(all((x - a) ** 2 + (y - b) ** 2 >= apart**2 for a, b in kept))
            if use[-1]:
                kept.append((x, y))
        return g[use]

    return rows.groupBy(key).applyInPandas(run, rows.schema)
