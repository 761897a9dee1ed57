"""Repairs of a network: which loose ends are worth a look, and the lines that answers to these cases add.

A *case* is a loose component near the main one, or a dead end that is near another part of the network but far from it
along the way.  A reader (a person, a model, recorded answers) says which of the case's points to connect; answers become
lines, and passes repeat until one adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import geometry as G
from netspark.operators import network, paths, spatial
from netspark.operators.components import connected_components
from netspark.plans.iterate import cut

# ---- fixed values of the method

LEAST_COMPONENT_M, MAX_GAP_M, DETOUR_M, APART_M, TARGETS, TARGET_APART_M, POINTS_APART_M = 100.0, 400.0, 2000.0, 150.0, 2, 25.0, 5.0
CROP_M, CROP_PX, LEAST_STEP_M = 400.0, 600, 0.5


def labelled_pieces(lines: DataFrame, snap: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Snapped pieces of lines (line_id, geom) with u, v, length_m and component; and the nodes (node, x, y, component,
    degree).  Loops are left out."""
    pieces = spatial.snap_ends(lines, snap).select(F.monotonically_increasing_id().alias("piece"), "geom")
    key = lambda p: F.xxhash64(F.round(p["x"] * 10).cast("long"), F.round(p["y"] * 10).cast("long"))
    pieces = pieces.select("piece", "geom", key(G.start("geom")).alias("u"), key(G.end("geom")).alias("v"), G.length("geom").alias("length_m"))
    pieces = cut(pieces.where("u <> v"))
    labels = cut(connected_components(pieces))
    pieces = cut(pieces.join(labels.withColumnRenamed("node", "u"), "u").select("piece", "u", "v", "length_m", "component", "geom"))
    ends = pieces.select(F.col("u").alias("node"), G.start("geom").alias("p")).unionByName(pieces.select(F.col("v").alias("node"), G.end("geom").alias("p")))
    nodes = ends.groupBy("node").agg(F.min("p").alias("p"), F.count("*").alias("degree")).join(labels, "node")
    return pieces, nodes.select("node", "p.x", "p.y", "component", "degree")


def main_component(pieces: DataFrame) -> DataFrame:
    """``component`` with the greatest length, the smaller label on ties."""
    return pieces.groupBy("component").agg(F.sum("length_m").alias("length_m")).orderBy(F.desc("length_m"), "component").limit(1).select("component")


def gaps_to_main(pieces: DataFrame, max_gap: float = MAX_GAP_M) -> DataFrame:
    """Per other component its distance to the main one, if within ``max_gap``: component, gap_m, a (its nearest point),
    b (the main one's).

    Pairs of pieces are looked up by buckets of their boxes, widened by the gap; exact distances decide.
    """
    top = F.broadcast(main_component(pieces))  # one row
    box = lambda p, r: [(c + d).alias(n) for c, d, n in zip(G.bounds("geom"), (-r, -r, r, r), ("xmin", "ymin", "xmax", "ymax"))]
    other = pieces.join(top, "component", "left_anti").select(F.col("piece").alias("id"), *box(pieces, max_gap))
    main = pieces.join(top, "component", "left_semi").select(F.col("piece").alias("id"), *box(pieces, 0.0))
    pairs = spatial.boxes_meet(other, main, max_gap)
    shape = lambda p: pieces.select(F.col("piece").alias(f"{p}_id"), F.col("geom").alias(f"{p}_geom"))
    pairs = pairs.join(shape("a").join(pieces.select(F.col("piece").alias("a_id"), "component"), "a_id"), "a_id").join(shape("b"), "b_id")
    pairs = pairs.select("component", "a_id", "b_id", G.closest("a_geom", "b_geom").alias("c")).where(F.col("c.dist") <= max_gap)
    best = pairs.groupBy("component").agg(F.min(F.struct("c.dist", "a_id", "b_id", "c.a", "c.b")).alias("m"))
    return best.select("component", F.col("m.dist").alias("gap_m"), "m.a", "m.b")


def component_cases(pieces: DataFrame, nodes: DataFrame, least: float = LEAST_COMPONENT_M, max_gap: float = MAX_GAP_M, prefix: str = "R") -> DataFrame:
    """Cases of components of at least ``least`` metres within ``max_gap`` of the main one: case_id, component, gap_m,
    component_m, a_points, b_points, centre.

    ``a_points``: the nearest point and the two dead ends nearest to the main network, each more than POINTS_APART_M from
    those before it; ``b_points``: the main network's points nearest to these, apart likewise.
    """
    size = pieces.groupBy("component").agg(F.sum("length_m").alias("component_m")).where(F.col("component_m") >= least)
    near = cut(gaps_to_main(pieces, max_gap).join(size, "component"))
    top = F.broadcast(main_component(pieces))  # one row
    main = pieces.join(top, "component", "left_semi").select(F.col("piece").alias("line_id"), "geom")
    ends = nodes.where("degree = 1").join(near.select("component"), "component", "left_semi").select(F.col("node").alias("id"), "x", "y", "component")
    # the two nearest ends of a component: those within reach first; further ones keep their order by distance to ``b``
    close = spatial.nearest_line(ends, main, 4 * max_gap).select("id", F.col("dist").alias("away"))
    ends = ends.join(close, "id", "left").join(near.select("component", "b"), "component")
    ends = ends.withColumn("away", F.coalesce("away", 4 * max_gap + F.hypot(F.col("x") - F.col("b.x"), F.col("y") - F.col("b.y"))))
    rank = F.row_number().over(Window.partitionBy("component").orderBy("away", "x", "y"))
    two = ends.withColumn("nth", rank).where("nth <= 2").groupBy("component").agg(F.sort_array(F.collect_list(F.struct("nth", F.struct("x", "y").alias("p")))).alias("two"))
    cases = near.join(two, "component", "left")
    tips = F.coalesce(F.transform("two", lambda t: t["p"]), F.array().cast(G.LINE))
    cases = cut(cases.withColumn("a_points", apart(F.concat(F.array("a"), tips), POINTS_APART_M)))
    asked = cases.select("component", F.posexplode("a_points").alias("no", "p")).select(F.struct("component", "no").alias("id"), "p.x", "p.y")
    hit = spatial.nearest_line(asked, main, 8 * max_gap).join(main.withColumnRenamed("line_id", "line"), "line")
    hit = hit.select("id.component", "id.no", G.point_at("geom", F.col("at")).alias("p"))
    hit = hit.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("no", "p"))).alias("hit"))
    cases = cases.join(hit, "component", "left").withColumn("b_points", apart(F.coalesce(F.transform("hit", lambda h: h["p"]), F.array("b")), POINTS_APART_M))
    order = network.dense_ids(cases.select(F.struct("gap_m", "component").alias("node")))
    cases = cases.join(order.select(F.col("node.component").alias("component"), "id"), "component")
    return cases.select(
        F.format_string(f"{prefix}%03d", F.col("id") + 1).alias("case_id"), "component", F.round("gap_m", 1).alias("gap_m"), F.round("component_m", 1).alias("component_m"),
        "a_points", "b_points", _middle(F.col("a"), F.col("b")).alias("centre"),
    )


def _middle(a: Column, b: Column) -> Column:
    return F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))


def apart(points: Column, least: float) -> Column:
    """Of an array of points those more than ``least`` from every one kept before them."""
    far = lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]) > least
    return F.aggregate(points, F.array().cast(G.LINE), lambda kept, p: F.when(F.forall(kept, lambda q: far(p, q)), F.array_append(kept, p)).otherwise(kept))


def cut_cases(pieces: DataFrame, nodes: DataFrame, max_gap: float = MAX_GAP_M, detour: float = DETOUR_M, prefix: str = "K") -> DataFrame:
    """Cases inside the main component: a dead end within ``max_gap`` of a piece whose two nodes are both further than
    ``detour`` along the network.

    case_id, node, gap_m, component_m (the detour that is exceeded), a_points, b_points (up to TARGETS points more than
    TARGET_APART_M apart), centre.  Of dead ends within APART_M of each other the first by place has the case.
    """
    top = F.broadcast(main_component(pieces))  # one row
    own = cut(pieces.join(top, "component", "left_semi"))
    ends = nodes.where("degree = 1").join(top, "component", "left_semi").select(F.col("node").alias("id"), "x", "y")
    reached = paths.shortest_paths(own.select("u", "v", F.col("length_m").alias("cost")), ends.select(F.col("id").alias("node")), detour)
    reached = cut(reached.select(F.col("origin").alias("id"), "node"))
    lines = own.select(F.col("piece").alias("line_id"), "geom")
    near = spatial.points_near_lines(ends, lines, max_gap).join(own.select(F.col("piece").alias("line"), "u", "v", "geom"), "line")
    for end in ("u", "v"):
        near = near.join(reached.select("id", F.col("node").alias(end)), ["id", end], "left_anti")
    near = near.select("id", "dist", "line", G.point_at("geom", F.col("at")).alias("p"))
    targets = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "line", "p"))).alias("near"))
    found = targets.select("id", F.get("near", F.lit(0))["dist"].alias("gap_m"), F.slice(apart(F.transform("near", lambda n: n["p"]), TARGET_APART_M), 1, TARGETS).alias("b_points")).join(ends, "id")
    kept = spaced_out(cut(found), ["x", "y", "id"], APART_M)
    order = network.dense_ids(kept.select(F.struct("x", "y", "id").alias("node")))
    kept = kept.join(order.select(F.col("node.id").alias("id"), F.col("id").alias("nth")), "id")
    point = F.struct("x", "y")
    return kept.select(
        F.format_string(f"{prefix}%03d", F.col("nth") + 1).alias("case_id"), F.col("id").alias("node"), F.round("gap_m", 1).alias("gap_m"), F.lit(detour).alias("component_m"),
        F.array(point).alias("a_points"), "b_points", _middle(point, F.get("b_points", F.lit(0))).alias("centre"),
    )


def spaced_out(rows: DataFrame, order: list[str], least: float) -> DataFrame:
    """Rows (id, x, y) in order that lie at least ``least`` from every row kept before them.

    What is kept depends only on rows that are linked by distances under ``least``: each such cluster is one group.
    """
    close = spatial.within_distance(rows, rows, least).where(F.col("a_id") != F.col("b_id")).where(F.col("dist") < least)
    labels = connected_components(close.select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    grouped = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        kept: list[tuple[float, float]] = []
        use = []
        for x, y in zip(g["x"], g["y"]):
            use.append(all((x - a) ** 2 + (y - b) ** 2 >= least**2 for a, b in kept))
            if use[-1]:
                kept.append((x, y))
        return g[use]

    return grouped.groupBy("cluster").applyInPandas(run, grouped.schema).drop("cluster")


# ---- answers


def case_affine(centre: Column, size: float = CROP_M, pixels: int = CROP_PX) -> Callable[[Column, Column], Column]:
    """From pixels of a case's picture to the map."""
    m = size / pixels
    return lambda u, v: F.struct((centre["x"] - size / 2 + u * m).alias("x"), (centre["y"] + size / 2 - v * m).alias("y"))


def apply_answers(cases: DataFrame, answers: DataFrame, label: str) -> DataFrame:
    """Lines of the cases whose answer (case_id, decision, from, to, waypoints_uv, reason) connects them.

    ``from`` and ``to`` name a point of either side ("A1", "B2"); answers that name none are left out, and so are lines
    of fewer than two points after points at most LEAST_STEP_M from the one before have gone.
    """
    number = lambda c, side: F.expr(f"try_cast(regexp_replace(`{c}`, '^{side}+', '') as int)")
    x = cases.join(answers.where("decision = 'connect'"), "case_id")
    first, last = (F.when(n >= 1, F.get(p, n - 1)) for n, p in ((number("from", "A"), "a_points"), (number("to", "B"), "b_points")))
    to_map = case_affine(F.col("centre"))
    way = F.transform(F.coalesce("waypoints_uv", F.array().cast("array<array<double>>")), lambda w: to_map(w[0], w[1]))
    x = x.withColumns({"first": first, "last": last}).where("first is not null and last is not null")
    points = F.concat(F.array("first"), way, F.array("last"))
    x = x.withColumn("points", points)
    moved = F.filter("points", lambda p, i: (i == 0) | (F.hypot(p["x"] - F.get("points", i - 1)["x"], p["y"] - F.get("points", i - 1)["y"]) > LEAST_STEP_M))
    x = x.withColumn("geom", moved).where(F.size("geom") >= 2)
    return x.select("case_id", F.lit(label).alias("label"), F.substring(F.coalesce("reason", F.lit("")), 1, 300).alias("reason"), "gap_m", "component_m", "geom")


def repair_passes(lines: DataFrame, answer: Callable[[DataFrame], DataFrame], label: str, prefixes: str = "RSTUVWXY", snap: float = 40.0) -> tuple[DataFrame | None, list[dict]]:
    """Passes over the network of ``lines`` (line_id long, geom) until one connects nothing: all repairs, and a summary a pass.

    ``answer`` takes cases and returns their answers; what one pass adds is part of the network of the next.
    """
    done, summary, extra = None, [], None
    for prefix in prefixes:
        all_ = lines.select("line_id", "geom") if extra is None else lines.select("line_id", "geom").unionByName(extra)
        pieces, nodes = labelled_pieces(all_, snap)
        cases = cut(component_cases(pieces, nodes, prefix=prefix))
        sizes = pieces.groupBy("component").agg(F.sum("length_m").alias("m"))
        n, big, most, total = sizes.agg(F.count("*"), F.count_if(F.col("m") >= LEAST_COMPONENT_M), F.max("m"), F.sum("m")).first()
        top_is_big = int((most or 0) >= LEAST_COMPONENT_M)
        summary.append({"pass": len(summary) + 1, "components": n, "components_ge_100m": big - top_is_big, "cases": cases.count(), "main_km": round((most or 0) / 1000, 1), "total_km": round((total or 0) / 1000, 1)})
        if not summary[-1]["cases"]:
            break
        rows = cut(apply_answers(cases, answer(cases), label))
        if rows.isEmpty():
            break
        done = rows if done is None else cut(done.unionByName(rows))
        extra = done.select((-1 - F.abs(F.xxhash64("case_id"))).alias("line_id"), "geom")
    return done, summary
