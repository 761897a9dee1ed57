"""Spatial joins as equi joins on grid buckets, with exact predicates after the join.

The bucket is as wide as the search radius, so one side is looked up in the nine buckets around it; segments and boxes
are put into every bucket that they touch.  Nothing is broadcast and no pair of distant rows is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import geometry as G


def cell(x, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size).cast("long")


def in_cells(df: DataFrame, size: float, xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax", reach: float = 0.0) -> DataFrame:
    """A row for each bucket (cx, cy) that a box, widened by ``reach``, touches."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    xs = F.sequence(cell(c(xmin) - reach, size), cell(c(xmax) + reach, size))
    ys = F.sequence(cell(c(ymin) - reach, size), cell(c(ymax) + reach, size))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def segment_cells(s: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """A row for each bucket (cx, cy) that a segment (x1, y1, x2, y2), widened by ``reach``, may touch.

    Column by column only the rows that the segment passes there, so a diagonal costs its length, not its box.
    """
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    s = s.withColumn("cx", F.explode(F.sequence(cell(lo - reach, size), cell(hi + reach, size))))
    dx = F.col("x2") - F.col("x1")
    at = lambda x: F.col("y1") + (F.col("y2") - F.col("y1")) * (F.least(F.greatest(x, lo), hi) - F.col("x1")) / F.when(dx == 0, 1.0).otherwise(dx)
    left, right = at(F.col("cx") * size - reach), at((F.col("cx") + 1) * size + reach)
    low = F.when(dx == 0, F.least("y1", "y2")).otherwise(F.least(left, right)) - reach
    high = F.when(dx == 0, F.greatest("y1", "y2")).otherwise(F.greatest(left, right)) + reach
    slack = 1e-9 * (1 + F.abs("y1") + F.abs("y2"))  # rounding of the interpolation
    return s.withColumn("cy", F.explode(F.sequence(cell(low - slack, size), cell(high + slack, size))))


def within_distance(a: DataFrame, b: DataFrame, r: float, keys: list[str] | None = None) -> DataFrame:
    """``a_id, b_id, dist`` of points (id, x, y) at most ``r`` apart, and of equal ``keys`` where these are given."""
    keys = list(keys or [])
    left = a.select(*keys, F.col("id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x", r).alias("cx"), cell("y", r).alias("cy"))
    right = in_cells(b.select(*keys, F.col("id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by")), r, "bx", "by", "bx", "by", r)
    dist = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return left.join(right, [*keys, "cx", "cy"]).select(*keys, "a_id", "b_id", dist.alias("dist")).where(F.col("dist") <= r)


def nearest(a: DataFrame, b: DataFrame, r: float) -> DataFrame:
    """``a_id, b_id, dist``: for each point of ``a`` the nearest of ``b`` within ``r``; the smaller id on ties."""
    best = within_distance(a, b, r).groupBy("a_id").agg(F.min(F.struct("dist", "b_id")).alias("m"))
    return best.select("a_id", "m.b_id", "m.dist")


def mutual_nearest(a: DataFrame, b: DataFrame, r: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs in which each is the other's nearest; with ``keys`` only points that agree in these columns are compared,
    and the keys come back with the pairs."""
    keys = list(keys)
    if keys:
        a, b = (x.withColumn("key_of", F.struct(*keys)) for x in (a, b))
        left = a.select("key_of", F.struct("key_of", "id").alias("id"), "x", "y")
        right = b.select("key_of", F.struct("key_of", "id").alias("id"), "x", "y")
        pairs = within_distance(left, right, r, ["key_of"]).select("key_of", F.col("a_id.id").alias("a_id"), F.col("b_id.id").alias("b_id"), "dist")
    else:
        pairs = within_distance(a, b, r).withColumn("key_of", F.lit(0))
    rank = lambda one, other: F.row_number().over(Window.partitionBy("key_of", one).orderBy("dist", other))
    pairs = pairs.withColumns({"ra": rank("a_id", "b_id"), "rb": rank("b_id", "a_id")}).where("ra = 1 and rb = 1")
    return pairs.select(*(F.col(f"key_of.{k}").alias(k) for k in keys), "a_id", "b_id", "dist")


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``id, polygon_id`` of points (id, x, y) in polygons (polygon_id, polygon); every match."""
    boxes = in_cells(polygons.select("polygon_id", "polygon", *G.bounds(F.element_at("polygon", 1))), size)
    boxes = boxes.select("polygon_id", "polygon", "xmin", "ymin", "xmax", "ymax", "cx", "cy")
    at = points.select("id", "x", "y", cell("x", size).alias("cx"), cell("y", size).alias("cy"))
    near = at.join(boxes, ["cx", "cy"]).where("x between xmin and xmax and y between ymin and ymax")
    return near.where(G.inside(F.col("x"), F.col("y"), F.col("polygon"))).select("id", "polygon_id")


def first_polygon(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """One polygon per point, the smallest id; null where there is none."""
    hit = points_in_polygons(points, polygons, size).groupBy("id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.join(hit, "id", "left")


def points_in_any(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """The rows of ``points`` (id, x, y, ...) that lie in one of the polygons at least: no union of shapes is made."""
    return points.join(points_in_polygons(points, polygons, size).select("id").distinct(), "id", "left_semi")


def polygons_meeting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """``a_id, b_id`` of polygons (polygon_id, polygon) that share a point: boxes first, then the shapes."""
    box = lambda p: p.select(F.col("polygon_id").alias("id"), *G.bounds(F.element_at("polygon", 1)))
    pairs = boxes_meet(box(a), box(b), size)
    pairs = pairs.join(a.select(F.col("polygon_id").alias("a_id"), F.col("polygon").alias("a_shape")), "a_id")
    pairs = pairs.join(b.select(F.col("polygon_id").alias("b_id"), F.col("polygon").alias("b_shape")), "b_id")
    return pairs.where(G.polygons_intersect("a_shape", "b_shape")).select("a_id", "b_id")


def coordinates(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (u, v, ...) with x1, y1, x2, y2 from ``nodes`` (node, x, y); an unknown node fails the query."""
    out = edges
    for end, x, y in (("u", "x1", "y1"), ("v", "x2", "y2")):
        at = nodes.select(F.col("node").alias(end), F.col("x").alias(x), F.col("y").alias(y), F.lit(True).alias(f"{end}_known"))
        out = out.join(at, end, "left").withColumn(x, F.when(F.col(f"{end}_known").isNull(), F.raise_error(F.concat(F.lit("no such node: "), F.col(end).cast("string")))).otherwise(F.col(x))).drop(f"{end}_known")
    return out


def boxes_meet(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """``a_id, b_id`` of boxes (id, xmin, ymin, xmax, ymax) that share a point; closed bounds."""
    left = in_cells(a.select(F.col("id").alias("a_id"), *(F.col(c).alias(f"a_{c}") for c in ("xmin", "ymin", "xmax", "ymax"))), size, "a_xmin", "a_ymin", "a_xmax", "a_ymax")
    right = in_cells(b.select(F.col("id").alias("b_id"), *(F.col(c).alias(f"b_{c}") for c in ("xmin", "ymin", "xmax", "ymax"))), size, "b_xmin", "b_ymin", "b_xmax", "b_ymax")
    meet = "a_xmin <= b_xmax and b_xmin <= a_xmax and a_ymin <= b_ymax and b_ymin <= a_ymax"
    # a pair counts in the bucket that holds the lower left corner of what both share
    own = (F.col("cx") == cell(F.greatest("a_xmin", "b_xmin"), size)) & (F.col("cy") == cell(F.greatest("a_ymin", "b_ymin"), size))
    return left.join(right, ["cx", "cy"]).where(meet).where(own).select("a_id", "b_id")


def points_near_lines(points: DataFrame, lines: DataFrame, r: float, key: str = "line_id", same: str | None = None) -> DataFrame:
    """``id, line, dist, at``: lines within ``r`` of points (id, x, y), and where the nearest point lies along them.

    ``same``: a column of both; only lines that agree with the point in it are compared.
    """
    keys = [same] if same else []
    named = lines.select(F.struct(F.col(key).alias("line"), *keys).alias("of"), "geom")
    s = G.segments(named, "of").select("of.*", "x1", "y1", "x2", "y2", "at")
    s = segment_cells(s, r, r)
    at = points.select("id", *keys, "x", "y", cell("x", r).alias("cx"), cell("y", r).alias("cy"))
    dist, t = G.point_segment(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    where = F.col("at") + t * F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    hit = at.join(s, [*keys, "cx", "cy"]).select("id", "line", dist.alias("dist"), where.alias("at")).where(F.col("dist") <= r)
    return hit.groupBy("id", "line").agg(F.min(F.struct("dist", "at")).alias("m")).select("id", "line", "m.dist", "m.at")


def nearest_line(points: DataFrame, lines: DataFrame, r: float, key: str = "line_id", same: str | None = None) -> DataFrame:
    """``id, line, dist, at``: the nearest line within ``r`` of each point, the smaller id on ties."""
    best = points_near_lines(points, lines, r, key, same).groupBy("id").agg(F.min(F.struct("dist", "line", "at")).alias("m"))
    return best.select("id", "m.line", "m.dist", "m.at")


def crossings(lines: DataFrame, size: float, key: str = "line_id") -> DataFrame:
    """``a, b, at_a, at_b``: points where two different lines (a < b) meet, by distance along each."""
    s = G.segments(lines, key)
    s = segment_cells(s, size)
    a = s.select(*(F.col(c).alias(f"a_{c}") for c in (key, "seg", "x1", "y1", "x2", "y2", "at")), "cx", "cy")
    b = s.select(*(F.col(c).alias(f"b_{c}") for c in (key, "seg", "x1", "y1", "x2", "y2", "at")), "cx", "cy")
    p = a.join(b, ["cx", "cy"]).where(F.col(f"a_{key}") < F.col(f"b_{key}"))
    p = p.withColumns({"rx": F.expr("a_x2 - a_x1"), "ry": F.expr("a_y2 - a_y1"), "sx": F.expr("b_x2 - b_x1"), "sy": F.expr("b_y2 - b_y1")})
    p = p.withColumn("cross", F.expr("rx * sy - ry * sx")).where("cross <> 0")
    p = p.withColumns({"t": F.expr("((b_x1 - a_x1) * sy - (b_y1 - a_y1) * sx) / cross"), "u": F.expr("((b_x1 - a_x1) * ry - (b_y1 - a_y1) * rx) / cross")})
    p = p.where("t between 0 and 1 and u between 0 and 1")
    return p.select(
        F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"),
        F.round(F.expr("a_at + t * hypot(rx, ry)"), 6).alias("at_a"), F.round(F.expr("b_at + u * hypot(sx, sy)"), 6).alias("at_b"),
    ).distinct()


def snap_ends(lines: DataFrame, snap: float = 40.0, key: str = "line_id") -> DataFrame:
    """``line_id, piece_no, geom, is_connector``: lines cut where they meet and joined where an end is near another.

    Each end looks at the nearest other line within ``snap``.  Where that line's nearest point is its own end (to 1e-6)
    nothing is cut; connectors longer than 0.05 m are added; pieces of at most 0.01 m vanish.
    """
    lines = lines.select(F.col(key).alias("line_id"), "geom")
    ends = lines.select("line_id", F.posexplode(F.array(G.start("geom"), G.end("geom"))).alias("no", "p"))
    ends = ends.select("line_id", "no", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.struct("line_id", "no").alias("id"))
    near = points_near_lines(ends, lines, snap).where(F.col("id.line_id") != F.col("line"))
    near = near.groupBy("id").agg(F.min(F.struct("dist", "line", "at")).alias("m")).select("id", "m.*")
    near = near.join(lines.select(F.col("line_id").alias("line"), F.col("geom").alias("other"), G.length("geom").alias("len")), "line")
    at_end = (F.col("at") <= 1e-6) | (F.col("at") >= F.col("len") - 1e-6)
    cuts = near.where(~at_end).select(F.col("line").alias("line_id"), "at")
    x = crossings(lines, snap)
    cuts = cuts.unionByName(x.select(F.col("a").alias("line_id"), F.col("at_a").alias("at"))).unionByName(x.select(F.col("b").alias("line_id"), F.col("at_b").alias("at")))
    cuts = cuts.groupBy("line_id").agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    pieces = lines.join(cuts, "line_id", "left").select("line_id", F.posexplode(G.split_line("geom", "cuts")).alias("piece_no", "geom"))
    meets = near.where("dist > 0.05").join(ends, "id")
    point = G.point_at("other", F.col("at"))
    connectors = meets.select("line_id", (-1 - F.col("no")).alias("piece_no"), F.array(F.struct("x", "y"), point).alias("geom"))
    return pieces.withColumn("is_connector", F.lit(False)).unionByName(connectors.withColumn("is_connector", F.lit(True)))


def graph_of(pieces: DataFrame, kmh: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) at ends rounded to decimetres and edges (u, v, length_m, cost in minutes) of line pieces."""
    e = pieces.select(G.start("geom").alias("a"), G.end("geom").alias("b"), G.length("geom").alias("length_m"))
    key = lambda p: F.xxhash64(F.round(F.col(p)["x"] * 10).cast("long"), F.round(F.col(p)["y"] * 10).cast("long"))
    e = e.select(key("a").alias("u"), key("b").alias("v"), "length_m", "a", "b")
    ends = e.select(F.col("u").alias("node"), F.col("a").alias("p")).unionByName(e.select(F.col("v").alias("node"), F.col("b").alias("p")))
    nodes = ends.groupBy("node").agg(F.min("p").alias("p")).select("node", "p.x", "p.y")
    return nodes, e.select("u", "v", "length_m", (F.col("length_m") / 1000 / kmh * 60).alias("cost"))


def build_edges(lines: DataFrame, most: float = 250.0, key: str = "line_id", footprint: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Equal pieces of at most ``most`` metres: edge_id ``<line>_<part>_<piece>``, length_m, geom, columns to ``keep``.

    ``footprint`` (one row, ``polygon``) clips the lines first; ``part`` numbers what is left of a line.  Lines are dealt
    out by their key, as one file of lines may give any number of pieces.
    """
    lines = lines.select(key, "geom", *keep).repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    if footprint is None:
        parts = lines.withColumn("part", F.lit(0))
    else:
        inside = lines.crossJoin(F.broadcast(footprint.select("polygon").limit(1)))  # one row
        parts = inside.select(key, *keep, F.posexplode(G.clip_line("geom", "polygon")).alias("part", "geom"))
    p = G.split_equal(parts, float(most))
    return p.select(F.concat_ws("_", F.col(key).cast("string"), "part", "piece").alias("edge_id"), key, "part", "piece", "length_m", "geom", *keep)


# ---- seams between tiles


def shared_edges(tiles: DataFrame, least: float = 1.0, slack: float = 0.01) -> DataFrame:
    """``tile_a, tile_b, x1, y1, x2, y2``: sides that two tiles (a < b) share for more than ``least`` metres.

    Tiles are looked up by the buckets their widened boxes touch; corners are no shared side.
    """
    size = tiles.agg(F.max(F.greatest(F.expr("xmax - xmin"), F.expr("ymax - ymin")))).first()[0] or 1.0
    t = tiles.select(F.col("tile_id").alias("id"), *(F.col(c) + d for c, d in (("xmin", -slack), ("ymin", -slack), ("xmax", slack), ("ymax", slack))))
    t = t.toDF("id", "xmin", "ymin", "xmax", "ymax")
    pairs = boxes_meet(t, t, float(size)).where("a_id < b_id")
    side = lambda p: tiles.select(F.col("tile_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("xmin", "ymin", "xmax", "ymax")))
    pairs = pairs.join(side("a"), "a_id").join(side("b"), "b_id")
    lo = {k: F.greatest(f"a_{k}min", f"b_{k}min") for k in "xy"}
    hi = {k: F.least(f"a_{k}max", f"b_{k}max") for k in "xy"}
    pairs = pairs.withColumns({"x1": lo["x"], "x2": hi["x"], "y1": lo["y"], "y2": hi["y"]})
    dx, dy = F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))
    upright = (dx <= slack) & (F.expr("y2 - y1") > least)
    level = (dy <= slack) & (F.expr("x2 - x1") > least)
    return pairs.where(upright | level).select(F.col("a_id").alias("tile_a"), F.col("b_id").alias("tile_b"), "x1", "y1", "x2", "y2")


def stitch(tiles: DataFrame, roads: DataFrame, end_m: float = 20.0, pair_m: float = 40.0) -> tuple[DataFrame, DataFrame]:
    """Seam joins and gaps of lines (tile_id, product_feature_id, geom) across shared sides.

    Line ends at most ``end_m`` from a side take part; two ends on either side that are each other's nearest, at most
    ``pair_m`` apart, are joined; every other end is a gap, once for each neighbour.
    """
    sides = shared_edges(tiles).withColumn("side", F.struct("tile_a", "tile_b"))
    ends = roads.select("tile_id", F.col("product_feature_id").alias("feature"), F.posexplode(F.array(G.start("geom"), G.end("geom"))).alias("end_no", "p"))
    dist, _ = G.point_segment(F.col("p.x"), F.col("p.y"), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    of = lambda tile: ends.join(sides.withColumnRenamed(tile, "tile_id"), "tile_id").withColumn("away", dist).where(F.col("away") <= end_m).select("side", "feature", "end_no", "p", "away")
    a, b = of("tile_a"), of("tile_b")
    p = a.select("side", *(F.col(c).alias(f"{c}_a") for c in ("feature", "end_no", "p"))).join(b.select("side", *(F.col(c).alias(f"{c}_b") for c in ("feature", "end_no", "p"))), "side")
    p = p.withColumn("gap_m", F.hypot(F.col("p_a.x") - F.col("p_b.x"), F.col("p_a.y") - F.col("p_b.y"))).where(F.col("gap_m") <= pair_m)
    rank = lambda x, y: F.row_number().over(Window.partitionBy("side", f"feature_{x}", f"end_no_{x}").orderBy("gap_m", f"feature_{y}", f"end_no_{y}"))
    p = p.withColumns({"ra": rank("a", "b"), "rb": rank("b", "a")}).where("ra = 1 and rb = 1")
    joins = p.select("side.tile_a", "side.tile_b", "feature_a", "feature_b", "gap_m", F.lit("seam_join").alias("kind"), F.array("p_a", "p_b").alias("geom"), "end_no_a", "end_no_b")
    gaps = []
    for x, ends_of, own, other in (("a", a, "tile_a", "tile_b"), ("b", b, "tile_b", "tile_a")):
        used = p.select("side", F.col(f"feature_{x}").alias("feature"), F.col(f"end_no_{x}").alias("end_no"))
        free = ends_of.join(used, ["side", "feature", "end_no"], "left_anti")
        name = F.when(F.col("end_no") == 0, "start").otherwise("end")
        gaps.append(free.select(F.col(f"side.{own}").alias("tile_id"), F.col(f"side.{other}").alias("neighbour"), "feature", name.alias("end"), F.col("away").alias("distance_to_edge_m"), F.lit("seam_gap").alias("kind"), F.array("p").alias("geom")))
    return joins.drop("end_no_a", "end_no_b"), gaps[0].unionByName(gaps[1])
