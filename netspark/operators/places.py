"""From places and networks to travel times and accessibility: the run that all other operators serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.functions import geometry as G
from netspark.functions.scalar import title_case
from netspark.operators import network, paths, spatial, surface
from netspark.operators.components import connected_components
from netspark.plans.iterate import cut

# ---- fixed values of the method

MAX_CONNECTOR_M, CONNECTOR_KMH, ZONE_OFFSET = 2000.0, 5.0, 10**12


def minutes(metres: Column, kmh: float) -> Column:
    return metres / 1000 / kmh * 60


def boundary_units(units: DataFrame, meta: DataFrame, relations: DataFrame, verified: tuple[str, ...] = ()) -> DataFrame:
    """Unit versions (geom_id, ref_code, name, type, type_id, start, end, polygons) with what is known about them.

    ``meta``: geom_id, ref_code, name_x, name_y, county.  ``relations``: geom_id, kind (pre or succ), other_id.
    """
    about = meta.select("geom_id", F.col("ref_code").alias("meta_ref_code"), F.col("name_x").alias("meta_name_x"), F.col("name_y").alias("meta_name_y"), F.col("county").cast("double").alias("county_code"), F.lit(True).alias("has_join_keys"))
    out = units.join(about.dropDuplicates(["geom_id"]), "geom_id", "left")
    for kind, name in (("pre", "predecessor_geom_ids"), ("succ", "successor_geom_ids")):
        ids = surface.joined_ids(relations.where(F.col("kind") == kind), "geom_id", "other_id").withColumnRenamed("ids", name)
        out = out.join(ids, "geom_id", "left").withColumn(name, F.coalesce(name, F.lit("")))
    area = F.aggregate(F.transform("polygons", lambda p: G.area(p)), F.lit(0.0), lambda s, a: s + a)
    return out.withColumns({
        "unit_id": F.concat(F.lit("unit:"), F.col("geom_id").cast("string")), "start_is_unbounded": F.col("start") == 0, "end_is_open": F.col("end") == 9999,
        "type_verified_upstream": F.col("type_id").isin(*verified) if verified else F.lit(False), "has_join_keys": F.coalesce("has_join_keys", F.lit(False)),
        "ref_code_disagrees": F.coalesce(F.col("meta_ref_code") != F.col("ref_code"), F.lit(False)),
        "geometry_kind": F.when(F.size("polygons") > 1, "MultiPolygon").otherwise("Polygon"), "n_parts": F.size("polygons"),
        "geometry_valid": F.forall("polygons", lambda p: G.valid_polygon(p)), "area_km2": F.round(area / 1e6, 6),
    })


def places(crosswalk: DataFrame, units: DataFrame, year: int, levels: tuple[str, ...], role: str = "core") -> DataFrame:
    """Places of the crosswalk (place, name, level, role, ref_code) with the unit that was valid in a year: polygon, x, y.

    Of several valid units of one code the first by ``geom_id`` counts.  ``units``: geom_id, ref_code, start, end, polygon.
    """
    wanted = crosswalk.where((F.col("role") == role) & F.col("level").isin(*levels))
    then = surface.first_by(surface.valid_at(units, year), ["ref_code"], ["geom_id"]).select("ref_code", "polygon")
    out = wanted.join(then, "ref_code").withColumn("at", G.representative_point("polygon"))
    return out.select("place", "name", "level", "ref_code", "polygon", "at.x", "at.y")


def period_graph(edges: DataFrame, nodes: DataFrame, modes: tuple[str, ...] = ("road",), walk_kmh: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of a period: edges (u, v, cost), positioned nodes of its largest component (node, x, y), and the
    segments of its roads (x1, y1, x2, y2).

    ``edges``: u, v, cost_min, length_m, mode; ``nodes``: node, x, y.  ``walk_kmh`` sets every road to one speed.  Edges
    of roads must have known ends; those of other modes may end at nodes without a place, which no zone connects to.
    """
    e = edges.where(F.col("mode").isin(*modes))
    cost = F.when(F.col("mode") == "road", minutes(F.col("length_m"), walk_kmh)).otherwise(F.col("cost_min")) if walk_kmh else F.col("cost_min")
    e = cut(e.select("u", "v", cost.cast("double").alias("cost"), "mode"))
    labels = cut(connected_components(e))
    top = F.broadcast(network.largest_component(e.withColumn("length_m", F.lit(0.0)), labels, by="nodes"))  # one row
    main = nodes.join(labels.join(top, "component", "left_semi").select("node"), "node", "left_semi").where("x is not null and y is not null")
    road = spatial.coordinates(e.where("mode = 'road'").select("u", "v"), nodes).select("x1", "y1", "x2", "y2")
    return e.select("u", "v", "cost"), main.select("node", "x", "y"), road


def connect(points: DataFrame, nodes: DataFrame, most: float = MAX_CONNECTOR_M, kmh: float = CONNECTOR_KMH) -> DataFrame:
    """``points`` (id, x, y, ...) with node, connector_m and access (minutes) of the nearest node within ``most``."""
    near = spatial.nearest(points, nodes.select(F.col("node").alias("id"), "x", "y"), most)
    near = near.select(F.col("a_id").alias("id"), F.col("b_id").alias("node"), F.col("dist").alias("connector_m"))
    return points.join(near, "id", "left").withColumn("access", minutes(F.col("connector_m"), kmh))


def surface_inputs(places_: DataFrame, population: DataFrame, graph: tuple[DataFrame, DataFrame, DataFrame], size: float = 250.0, bucket: float = 5000.0) -> tuple[DataFrame, DataFrame]:
    """Edges with zone connectors, and the zones of a population surface (zone, kind, population, road_m, x, y, node,
    connector_m, access, zone_node).

    Parishes are cut into cells, over which their people are spread by road length; towns are zones of their own.
    ``population``: place, population.  Zones without a node within reach are not connected (zone_node stays, no edge).
    """
    edges, nodes, road = graph
    parish = places_.where("level = 'parish'").select(F.col("place").alias("polygon_id"), "polygon")
    boxes = parish.select(*G.bounds(F.element_at("polygon", 1)))
    cells = surface.grid_cells(boxes, size).select(F.concat(F.lit("c"), F.col("x").cast("long").cast("string"), F.lit("_"), F.col("y").cast("long").cast("string")).alias("id"), "cx", "cy", "x", "y")
    inside = spatial.points_in_polygons(cells, parish, bucket).groupBy("id").agg(F.min("polygon_id").alias("place"))
    cells = cells.join(inside, "id").join(surface.road_length(road, size), ["cx", "cy"], "left").withColumn("road_m", F.coalesce("road_m", F.lit(0.0)))
    cells = surface.disaggregate(cells, population).select("id", F.lit("cell").alias("kind"), "population", "road_m", "x", "y")
    towns = places_.where("level <> 'parish'").join(population, "place", "left")
    towns = towns.select(F.col("place").alias("id"), F.lit("town").alias("kind"), F.coalesce("population", F.lit(0.0)).alias("population"), F.lit(0.0).alias("road_m"), "x", "y")
    zones = connect(cut(cells.unionByName(towns)), nodes).withColumnRenamed("id", "zone")
    return network.with_connectors(edges, zones, ZONE_OFFSET)


def times_from(edges: DataFrame, zones: DataFrame, origin: str, places_: DataFrame, size: float = 250.0) -> DataFrame:
    """``place, name, minutes`` from the zone ``origin`` to the connected cell nearest to each parish's point, null if
    that is further than ``size`` away; empty if the origin isn't connected."""
    linked = zones.where("node is not null")
    start = linked.where(F.col("zone") == origin).select(F.col("zone_node").alias("node"))
    ways = paths.shortest_paths(edges, start).select(F.col("node").alias("zone_node"), F.col("dist").alias("minutes"))
    parish = places_.where("level = 'parish'")
    cells = linked.where("kind = 'cell'").select(F.col("zone_node").alias("id"), "x", "y")
    near = spatial.nearest(parish.select(F.col("place").alias("id"), "x", "y"), cells, size)
    near = near.select(F.col("a_id").alias("place"), F.col("b_id").alias("zone_node")).join(ways, "zone_node").select("place", "minutes")
    return parish.join(F.broadcast(start.limit(1).select(F.lit(1).alias("one"))), how="cross").join(near, "place", "left").select("place", title_case("name").alias("name"), "minutes")


def travel_time_table(times: DataFrame, periods: list[str]) -> DataFrame:
    """Times (period, name, minutes) as a row a place and a column a period, by the last period, unknown last."""
    table = times.where("minutes is not null").groupBy("name").pivot("period", periods).agg(F.avg("minutes"))
    return table.orderBy(F.col(f"`{periods[-1]}`").asc_nulls_last(), "name")


def place_run(edges: DataFrame, nodes: DataFrame, places_: DataFrame, population: DataFrame, target: str, period: str, tau: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """The place-level run of one period: a row a place (period, place, name, connector_m, minutes_to_target,
    reachable_places, accessibility, accessibility_share_of_max), and the times between places.

    Places snap to any node within reach; times are ways plus both access legs.
    """
    at = cut(connect(places_.select(F.col("place").alias("id"), "name", "x", "y"), nodes).withColumnRenamed("id", "place"))
    times = cut(network.travel_times(edges, at))
    other = times.where("origin <> destination").join(population.select(F.col("place").alias("destination"), "population"), "destination")
    acc = other.groupBy("origin").agg(F.sum(F.coalesce("population", F.lit(0.0)) * F.exp(-F.col("minutes") / tau)).alias("accessibility"))
    to = times.where(F.col("destination") == target).select("origin", F.col("minutes").alias("minutes_to_target"))
    out = at.select("place", "name", "connector_m")
    for part in (to, network.reachable(times), acc):
        out = out.join(part.withColumnRenamed("origin", "place"), "place", "left")
    out = out.withColumns({"period": F.lit(period), "reachable_places": F.coalesce("reachable", F.lit(0)), "accessibility": F.coalesce("accessibility", F.lit(0.0))})
    own = F.when(F.col("place") == target, F.lit(0.0)).otherwise(F.col("minutes_to_target"))
    top = F.max("accessibility").over(Window.partitionBy("period"))
    share = F.when(top > 0, F.col("accessibility") / top)
    return out.select("period", "place", "name", "connector_m", own.alias("minutes_to_target"), "reachable_places", "accessibility", share.alias("accessibility_share_of_max")), times
