"""A past network from a present one: edges matched to scored pieces of map lines, gaps bridged, other modes added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.operators import network, spatial
from netspark.plans.iterate import cut


def edge_status(edges: DataFrame, nodes: DataFrame, scored: DataFrame, footprints: DataFrame, match_m: float = 10.0, bucket: float = 5000.0) -> DataFrame:
    """``edges`` (edge, u, v, mode, way, ...) with ``status``.

    A road whose middle lies in a footprint (polygon_id, polygon) takes ``present`` of the nearest scored piece (way,
    present, geom) of the same way within ``match_m``, else it is unscored; other roads and modes are not checked.
    """
    mid = spatial.coordinates(edges, nodes).select("edge", "way", "mode", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    roads = mid.where("mode = 'road'").select(F.col("edge").alias("id"), "way", "x", "y")
    inside = cut(spatial.points_in_any(roads, footprints, bucket))
    pieces = scored.where("way is not null").select(F.struct(F.monotonically_increasing_id().alias("k"), "present").alias("line_id"), "way", "geom")
    hit = spatial.nearest_line(inside.where("way is not null"), pieces, match_m, same="way").select(F.col("id").alias("edge"), F.col("line.present").alias("found"))
    out = edges.join(inside.select(F.col("id").alias("edge"), F.lit(True).alias("inside")), "edge", "left").join(hit, "edge", "left")
    road = F.when(F.col("inside"), F.coalesce("found", F.lit("unscored"))).otherwise("modern, not checked")
    return out.withColumn("status", F.when(F.col("mode") == "road", road).otherwise("modern rail, not checked")).drop("inside", "found")


def past_network(
    edges: DataFrame, nodes: DataFrame, scored: DataFrame, footprints: DataFrame, rail: DataFrame | None = None, stations: DataFrame | None = None,
    max_gap: float = 300.0, min_detour: float = 2000.0, gap_status: str = "gap bridged", rail_status: str = "rail", access_min: float = 1.0, match_m: float = 10.0,
) -> tuple[DataFrame, DataFrame]:
    """Edges that a past network keeps (u, v, cost_min, length_m, mode, status) and the kilometres of every status.

    Everything but absent edges stays, and absent ones that bridge a gap to a stranded fragment or a cut with a long
    detour.  ``rail`` (from_key, to_key, cost_min) runs between ``stations`` (key, station_node, road_node), each linked to
    its road node by ``access_min``; of repeated keys the first by node counts.
    """
    known = nodes.select("node")
    inside = edges.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi")
    e = cut(edge_status(inside, nodes, scored, footprints, match_m))

    def bridged(e: DataFrame, found: DataFrame) -> DataFrame:
        return cut(e.join(found.withColumn("add", F.lit(True)), "edge", "left").withColumn("status", F.when(F.col("add"), gap_status).otherwise(F.col("status"))).drop("add"))

    short = lambda e: e.select("edge", "u", "v", "length_m", "status")
    e = bridged(e, network.bridge_gaps(short(e), max_gap))
    e = bridged(e, network.bridge_cuts(short(e), max_gap, min_detour))
    out = e.where("status <> 'absent'").select("u", "v", "cost_min", "length_m", "mode", "status")
    if rail is not None:
        one = stations.groupBy("key").agg(F.min(F.struct("station_node", "road_node")).alias("s")).select("key", "s.*")
        at = lambda c, end: one.select(F.col("key").alias(c), F.col("station_node").alias(end))
        none = F.lit(None).cast("double").alias("length_m")
        lines = rail.join(at("from_key", "u"), "from_key").join(at("to_key", "v"), "to_key").select("u", "v", F.col("cost_min").cast("double").alias("cost_min"), none, F.lit("rail").alias("mode"), F.lit(rail_status).alias("status"))
        used = rail.select(F.col("from_key").alias("key")).unionByName(rail.select(F.col("to_key").alias("key"))).distinct()
        links = one.join(used, "key", "left_semi").select(F.col("station_node").alias("u"), F.col("road_node").alias("v"), F.lit(float(access_min)).alias("cost_min"), none, F.lit("station_access").alias("mode"), F.lit(rail_status).alias("status"))
        out = out.unionByName(lines).unionByName(links)
    return out, e.groupBy("status").agg(F.round(F.sum(F.col("length_m") / 1000), 1).alias("km"))
