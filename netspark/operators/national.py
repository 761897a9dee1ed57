"""Estimates over the whole country from metadata, the assembly of read tiles, and what the reading cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import geometry as G
from netspark.functions.scalar import unit_costs
from netspark.operators import paths, repair, reviews, search, spatial, surface
from netspark.operators.search import PACK
from netspark.plans.iterate import cut

# ---- fixed values of the method: rates measured for one tile

RATES = {
    "reading_bn": 110_444 / 1e9, "reading_fresh_in_bn": 22_234 / 1e9, "reading_cached_in_bn": 79_081 / 1e9, "reading_out_bn": 9_129 / 1e9,
    "review_bn": 53_319 / 1e9, "model_hours": (6.4 + 3.4) / 60, "days_at_band_pace": 1 / (34 / (42 / 60)) / 24,
}
CELL_M, SAMPLE_M = 1000.0, 50.0


def coverage_cells(sheets: DataFrame, size: float = CELL_M) -> DataFrame:
    """``cell`` of every cell whose centre a readable sheet covers (xmin, ymin, xmax, ymax, status), closed bounds."""
    first, last = (lambda c: F.ceil(F.col(c) / size - 0.5)), (lambda c: F.floor(F.col(c) / size - 0.5))
    s = sheets.where("status = 'ok'").where((first("xmin") <= last("xmax")) & (first("ymin") <= last("ymax")))
    s = s.select(F.explode(F.sequence(first("xmin"), last("xmax"))).alias("ix"), "ymin", "ymax").select("ix", F.explode(F.sequence(first("ymin"), last("ymax"))).alias("iy"))
    return s.select((F.col("ix").cast("long") * PACK + F.col("iy")).alias("cell")).distinct()


def cells_of_areas(areas: DataFrame, size: float = CELL_M, within: DataFrame | None = None) -> DataFrame:
    """``polygon_id, ix, iy`` of cells whose centre lies in an area (polygon_id, polygon), and in one of ``within``."""
    box = areas.select("polygon_id", "polygon", *G.bounds(F.element_at("polygon", 1)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size).cast("long"), F.greatest(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1).cast("long"))
    c = box.select("polygon_id", "polygon", "ymin", "ymax", F.explode(span("xmin", "xmax")).alias("ix")).select("polygon_id", "polygon", "ix", F.explode(span("ymin", "ymax")).alias("iy"))
    c = c.withColumns({"x": (F.col("ix") + 0.5) * size, "y": (F.col("iy") + 0.5) * size}).where(G.inside(F.col("x"), F.col("y"), F.col("polygon")))
    if within is not None:
        spots = c.select(F.struct("ix", "iy").alias("id"), "x", "y").distinct()
        c = c.join(spatial.points_in_any(spots, within, 10 * size).select("id.ix", "id.iy"), ["ix", "iy"], "left_semi")
    return c.select("polygon_id", "ix", "iy")


def start_cells(lines: DataFrame, towns: DataFrame, size: float = CELL_M, step: float = SAMPLE_M) -> DataFrame:
    """``ix, iy`` of cells with a vertex of a line (geom, cut at ``step``) or a town (x, y)."""
    v = lines.select(F.explode(G.segmentised("geom", F.lit(step))).alias("p")).select("p.x", "p.y").unionByName(towns.select("x", "y"))
    return v.select(spatial.cell("x", size).alias("ix"), spatial.cell("y", size).alias("iy")).distinct()


def estimate(cells: DataFrame, vertices: DataFrame, towns: DataFrame, variants: dict[str, tuple[int, ...]], base: int = 0, size: float = CELL_M, seed_radius: int = 3) -> DataFrame:
    """Per covered cell (cell, parish, county; parish null at sea) and variant: road_m, lb (on a shortest way from the
    start to some parish), read (a goal-directed search reads it), start.

    ``vertices``: line, ord, x, y, grp (group of roads); a variant is a set of groups; searches start at cells of the
    ``base`` group and at town cells (cell) with road.  A parish's target is its cell with most road, the smaller on ties.
    """
    out = cells.withColumn("land", F.col("parish").isNotNull())
    inside = cells.select(F.col("cell").alias("u"))
    for name, groups in variants.items():
        tiles, links = search.tile_graph(vertices, size, list(groups))
        links = cut(links.join(inside, "u", "left_semi").join(inside.withColumnRenamed("u", "v"), "v", "left_semi"))
        linked = cut(paths.symmetric(links).select(F.col("u").alias("cell")).distinct())
        touched = search.tile_graph(vertices, size, [base])[1]
        start = paths.symmetric(touched).select(F.col("u").alias("cell")).distinct().join(cells.select("cell"), "cell", "left_semi")
        start = cut(start.unionByName(towns.select("cell").join(linked, "cell", "left_semi")).distinct())
        road = cells.join(tiles, "cell", "left").withColumn("road", F.coalesce("length_m", F.lit(0.0)))
        best = surface.first_by(road.where("parish is not null").join(linked, "cell", "left_semi"), ["parish"], [F.desc("road"), F.col("cell")])
        tree = cut(paths.bfs(links, start.select(F.col("cell").alias("node"))))
        reach = cut(best.select(F.col("cell").alias("node")).join(tree.select("node", "depth"), "node").distinct())
        bound = paths.trace(tree.withColumn("edge", F.lit(None).cast("long")), reach.select("node")).select(F.col("node").alias("cell")).distinct()
        region = lambda d: d.withColumn("region", F.lit(name))  # noqa: B023, E731
        read = search.goal_directed(region(links), region(start), region(reach.select(F.col("node").alias("cell"), "depth")), seed_radius=seed_radius)
        read = read.select("cell").unionByName(start).distinct()
        out = out.join(road.select("cell", F.col("road").alias(f"road_m_{name}")), "cell", "left")
        for mark, found in (("lb", bound), ("read", read), ("start", start)):
            out = cut(out.join(found.select("cell", F.lit(True).alias("hit")), "cell", "left").withColumn(f"{mark}_{name}", F.coalesce("hit", F.lit(False))).drop("hit"))
    return out


def county_table(cells: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """Land cells, cells with road, cells a search reads and cells on shortest ways, per county; no county is one, too."""
    yes = lambda c: F.count_if(F.col(c))
    parts = [F.count("*").alias("land_tiles")]
    parts += [F.count_if(F.col(f"road_m_{v}") > 0).alias(f"any_road_{v}") for v in variants]
    parts += [yes(f"read_{v}").alias(f"search_{v}") for v in variants] + [yes(f"lb_{v}").alias(f"lb_{v}") for v in variants]
    return cells.where("land").groupBy("county", "county_name").agg(*parts).orderBy("county", "county_name")


def cost_table(counts: DataFrame, column: str = "n") -> DataFrame:
    """``counts`` with what reading so many tiles costs (``RATES`` a tile)."""
    return counts.select("*", *unit_costs(column, RATES))


# ---- read tiles


def assemble(answers: DataFrame, tiles: DataFrame, state: DataFrame, producer: str, reviewer: str, provenance: dict[str, str]) -> dict[str, DataFrame]:
    """Layers of all tiles whose state (tile_id, status, round) is ok: roads with their round, seam_joins, seam_gaps, tiles.

    ``answers``: tile_id, pass_a, pass_c; ``tiles``: tile_id, display_w, display_h, xmin, ymin, xmax, ymax.  Lines are in
    map metres: a face of ``display_w`` by ``display_h`` pixels lies over the tile's box.
    """
    ok = state.where("status = 'ok'").select("tile_id", "round")
    use = tiles.join(ok.select("tile_id"), "tile_id", "left_semi")
    made = reviews.tile_products(answers.join(ok.select("tile_id"), "tile_id", "left_semi"), use, producer, reviewer, provenance)["product"]
    on_map = lambda p: F.struct((F.col("xmin") + p["x"] * (F.col("xmax") - F.col("xmin")) / F.col("display_w")).alias("x"), (F.col("ymax") - p["y"] * (F.col("ymax") - F.col("ymin")) / F.col("display_h")).alias("y"))
    roads = made.join(use, "tile_id").withColumn("geom", F.transform("geom", on_map)).join(ok, "tile_id")
    keep = ["product_feature_id", "tile_id", "feature_id", "provenance_kind", "verdict", "proposed_class", "coarse_class", "round", "geom"]
    roads = cut(roads.select(*keep, G.length("geom").alias("length_m")))
    joins, gaps = spatial.stitch(use, roads)
    lines = roads.groupBy("tile_id").agg(F.count("*").alias("lines"))
    layer = state.join(lines, "tile_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return {"roads": roads, "seam_joins": joins, "seam_gaps": gaps, "tiles": layer}


def connected_network(lines: DataFrame, size: float = CELL_M, step: float = SAMPLE_M, snap: float = 40.0) -> dict[str, DataFrame]:
    """The largest component of snapped lines (line_id, geom): its ``cells`` (ix, iy; a sample every ``step`` at most), its
    dead ``ends`` (node, x, y), and ``sizes`` (component, length_m) of all components."""
    pieces, nodes = repair.labelled_pieces(lines, snap)
    top = F.broadcast(repair.main_component(pieces))  # one row
    own = cut(pieces.join(top, "component", "left_semi"))
    n = F.greatest(F.lit(2), (F.floor(F.col("length_m") / step) + 2).cast("int"))
    at = own.select("geom", "length_m", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: k / (n - 1))).alias("t"))
    p = at.select(G.point_at("geom", F.col("t") * F.col("length_m")).alias("p")).select("p.x", "p.y")
    cells = p.select(spatial.cell("x", size).alias("ix"), spatial.cell("y", size).alias("iy")).distinct()
    ends = nodes.where("degree = 1").join(top, "component", "left_semi").select("node", "x", "y")
    return {"cells": cells, "ends": ends, "sizes": pieces.groupBy("component").agg(F.sum("length_m").alias("length_m"))}


def strict_frontier(ends: DataFrame, attempted: DataFrame, near: float = 20.0, size: float = CELL_M) -> DataFrame:
    """``ix, iy``: cells nobody attempted, next to a dead end (x, y) of an attempted cell within ``near`` of their side."""
    at = ends.withColumns({"ix": spatial.cell("x", size), "iy": spatial.cell("y", size)}).join(attempted.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi")
    dx, dy = F.col("x") - F.col("ix") * size, F.col("y") - F.col("iy") * size
    sides = F.array_compact(F.array(*(F.when(d <= near, F.lit(k)) for k, d in (("w", dx), ("e", size - dx), ("s", dy), ("n", size - dy)))))
    return search.frontier(at.select("ix", "iy", F.explode(sides).alias("side")), attempted)


def fill_batches(cells: DataFrame, attempted: DataFrame, n: int = 24) -> DataFrame:
    """``ix, iy, batch`` of cells not yet attempted, ``n`` a batch, in the order of cells."""
    return search.batches(cells.select("ix", "iy").distinct().join(attempted.select("ix", "iy"), ["ix", "iy"], "left_anti"), ["ix", "iy"], n)


# ---- what the runs did


def audit(events: DataFrame, allowed: DataFrame, model: str) -> DataFrame:
    """Per run of an event stream (run, line: JSON text): models, files read and written, other tools, tokens, cost, and
    whether it kept the rules.

    ``allowed``: run, file, kind (``read`` or ``write``).  The rules: only ``model`` ran, nothing but allowed files was
    read, exactly the files to write were written, no other tool was used.  Lines that are no JSON are skipped.
    """
    v = F.try_parse_json("line")
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    e = events.withColumn("v", v).where(F.col("v").isNotNull())
    models = e.select("run", get(F.col("v"), "$.message.model", "string").alias("model"))
    by_use = e.where(get(F.col("v"), "$.type", "string") == "result").select("run", F.explode(F.map_keys(get(F.col("v"), "$.modelUsage", "map<string,variant>"))).alias("model"))
    models = models.unionByName(by_use).where("model is not null and model <> ''").groupBy("run").agg(F.array_sort(F.collect_set("model")).alias("models"))
    uses = e.select("run", F.explode(get(F.col("v"), "$.message.content", "array<variant>")).alias("c")).where(get(F.col("c"), "$.type", "string") == "tool_use")
    uses = uses.select("run", get(F.col("c"), "$.name", "string").alias("tool"), get(F.col("c"), "$.input.file_path", "string").alias("file"))
    ok = allowed.select("run", "file", "kind").distinct()
    uses = uses.withColumn("kind", F.when(F.col("tool") == "Read", "read").when(F.col("tool") == "Write", "write").otherwise("other"))
    uses = uses.join(ok.withColumn("allowed", F.lit(True)), ["run", "file", "kind"], "left")
    is_, fine = (lambda k: F.col("kind") == k), F.coalesce("allowed", F.lit(False))
    tools = uses.groupBy("run").agg(
        F.count_if(is_("read")).alias("reads"), F.array_sort(F.collect_set(F.when(is_("read") & ~fine, F.col("file")))).alias("reads_outside"),
        F.array_sort(F.collect_list(F.when(is_("write"), F.col("file")))).alias("writes"), F.array_sort(F.collect_list(F.when(is_("other"), F.coalesce("file", "tool")))).alias("other_tools"),
    )
    to_write = ok.where("kind = 'write'").groupBy("run").agg(F.array_sort(F.collect_list("file")).alias("to_write"))
    usage = lambda k: F.coalesce(get(F.col("v"), f"$.usage.{k}", "long"), F.lit(0))
    tokens = sum((usage(k) for k in ("cache_creation_input_tokens", "cache_read_input_tokens", "output_tokens")), usage("input_tokens"))
    ends = e.where(get(F.col("v"), "$.type", "string") == "result").groupBy("run").agg(F.max(tokens).alias("tokens"), F.max(get(F.col("v"), "$.total_cost_usd", "double")).alias("cost_usd"))
    out = events.select("run").distinct()
    for part in (models, tools, to_write, ends):
        out = out.join(part, "run", "left")
    none = F.array().cast("array<string>")
    for c in ("models", "reads_outside", "writes", "other_tools", "to_write"):
        out = out.withColumn(c, F.coalesce(c, none))
    kept = (F.size("reads_outside") == 0) & (F.size("other_tools") == 0) & (F.col("writes") == F.col("to_write"))
    return out.withColumns({"reads": F.coalesce("reads", F.lit(0)), "tools_ok": kept, "ok": kept & (F.col("models") == F.array(F.lit(model)))}).drop("to_write")


def accounting(runs: DataFrame, by: str = "kind") -> DataFrame:
    """Per kind of run (wall_s, tokens, attempt, ok): how many, hours, median minutes, tokens, retries, how many were ok."""
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.round(F.sum("wall_s") / 3600, 1).alias("hours"), F.round(F.median("wall_s") / 60, 1).alias("median_min"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("attempt") > 1).alias("retries"), F.count_if(F.col("ok")).alias("passed"),
    )


def demo(lines: DataFrame, places_: DataFrame, population: DataFrame, target: str, answer=None, period: str = "past", kmh: float = 5.0) -> dict:
    """Lines to accessibility in one call: repairs from recorded answers, the graph of the largest part, the place run."""
    from netspark.operators import places

    done, passes = repair.repair_passes(lines, answer, "recorded answer") if answer else (None, [])
    all_ = lines.select("line_id", "geom") if done is None else lines.select("line_id", "geom").unionByName(done.select((-1 - F.abs(F.xxhash64("case_id"))).alias("line_id"), "geom"))
    pieces, nodes = repair.labelled_pieces(all_)
    top = F.broadcast(repair.main_component(pieces))  # one row
    edges = cut(pieces.join(top, "component", "left_semi").select("u", "v", places.minutes(F.col("length_m"), kmh).alias("cost")))
    nodes = nodes.join(top, "component", "left_semi").select("node", "x", "y")
    table, times = places.place_run(edges, nodes, places_, population, target, period)
    return {"repairs": done, "passes": passes, "places": table, "times": times}


def ranked(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of every group in an order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= k)
