"""Network operators: degree, largest component, bridging of gaps and of long detours, accessibility."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netspark.operators.components import connected_components
from netspark.operators.paths import BROADCAST_EDGES, cheapest, compact, shortest_paths, nearest_source, symmetric, trace
from netspark.plans.iterate import cut, free


def degree(edges: DataFrame) -> DataFrame:
    """``node, degree``: how many edge ends stand at a node; dead ends have one."""
    return symmetric(edges.select("u", "v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def component_sizes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per component: its nodes and the length of its edges."""
    length = edges.join(labels.select(F.col("node").alias("u"), "component"), "u").groupBy("component").agg(F.sum("length_m").alias("length_m"))
    return labels.groupBy("component").agg(F.count("*").alias("nodes")).join(length, "component", "left")


def largest_component(edges: DataFrame, labels: DataFrame, by: str = "length_m") -> DataFrame:
    """Label of the largest component, by ``length_m`` or ``nodes``; the smaller label on ties."""
    if by not in ("length_m", "nodes"):
        raise ValueError("by is 'length_m' or 'nodes'")
    return component_sizes(edges, labels).orderBy(F.desc_nulls_last(by), "component").limit(1).select("component")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """``node, id``: 0, 1, 2 ... in the order of nodes, without moving all rows to one task."""
    parts = nodes.select("node").distinct().repartitionByRange("node").withColumn("part", F.spark_partition_id())
    parts = cut(parts.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("node"))))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).select("part", "before")
    return parts.join(before, "part").select("node", (F.col("before") + F.col("k") - 1).alias("id"))


def _split_by_status(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rows (every status but absent) and absent ones."""
    absent = F.coalesce(F.col("status") == "absent", F.lit(False))
    return edges.where(~absent), edges.where(absent)


def bridge_gaps(edges: DataFrame, max_gap: float = 300.0) -> DataFrame:
    """``edge`` of the absent rows that join stranded fragments to the largest kept component (by length).

    ``edges``: edge, u, v, length_m, status.  Per fragment the one cheapest chain of at most ``max_gap`` absent metres
    counts; crossing other kept fragments on the way is free.  Fragments are contracted, so the search runs over
    absent rows only.
    """
    kept, absent = _split_by_status(edges)
    labels = cut(connected_components(kept))
    main = largest_component(kept, labels)
    # fragments and the nodes outside all of them get ids of their own, whatever the nodes' ids are
    ends = symmetric(absent.select("u", "v")).select(F.col("u").alias("node")).distinct()
    vertex = ends.join(labels, "node", "left").unionByName(labels.join(ends, "node", "left_anti"))
    vertex = vertex.select("node", F.struct(F.col("component").isNull().alias("outside"), F.coalesce("component", "node").alias("name")).alias("vertex"))
    vertex = cut(vertex.join(dense_ids(vertex.select(F.col("vertex").alias("node"))).withColumnRenamed("node", "vertex"), "vertex"))
    at = lambda c: vertex.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
    linked = absent.join(at("u"), "u").join(at("v"), "v").select(F.col("u_id").alias("u"), F.col("v_id").alias("v"), F.col("length_m").alias("cost"), "edge")
    source = vertex.join(main.select(F.struct(F.lit(False).alias("outside"), F.col("component").alias("name")).alias("vertex")), "vertex", "left_semi")
    found = cut(nearest_source(linked, source.select(F.col("id").alias("node")).distinct(), max_gap))
    fragments = vertex.where("not vertex.outside").select(F.col("id").alias("node")).distinct()
    return trace(found, fragments).where("edge is not null").select("edge").distinct()


def bridge_cuts(edges: DataFrame, max_gap: float = 300.0, min_detour: float = 2000.0) -> DataFrame:
    """``edge`` of absent rows on paths of at most ``max_gap`` between kept nodes that are more than ``min_detour``
    apart along kept road (or not connected by it)."""
    kept, absent = (x.withColumn("cost", F.col("length_m")) for x in _split_by_status(edges))
    on_kept = symmetric(kept.select("u", "v")).select(F.col("u").alias("node")).distinct()
    starts = cut(symmetric(absent.select("u", "v")).select(F.col("u").alias("node")).distinct().join(on_kept, "node", "left_semi"))
    short = cut(shortest_paths(absent, starts, max_gap))
    pairs = short.join(on_kept, "node", "left_semi").where("node > origin").select("origin", "node")
    along = shortest_paths(kept, pairs.select(F.col("origin").alias("node")), min_detour).select("origin", "node")
    far = cut(pairs.join(along, ["origin", "node"], "left_anti"))
    return trace(short, far, ("origin",)).where("edge is not null").select("edge").distinct()


def travel_times(edges: DataFrame, places: DataFrame, limit: float = float("inf")) -> DataFrame:
    """``origin, destination, minutes`` between places (place, node, access): the way plus both access legs.

    A place reaches itself in 0; places without a node are left out, unreachable pairs too.
    """
    at = places.where("node is not null")
    ways = shortest_paths(edges, at.select("node").distinct(), limit)
    out = ways.join(at.select(F.col("place").alias("origin_place"), F.col("node").alias("origin"), F.col("access").alias("a")), "origin")
    out = out.join(at.select(F.col("place").alias("destination"), "node", F.col("access").alias("b")), "node")
    minutes = F.when(F.col("origin_place") == F.col("destination"), 0.0).otherwise(F.col("dist") + F.col("a") + F.col("b"))
    return out.select(F.col("origin_place").alias("origin"), "destination", minutes.alias("minutes"))


def reachable(times: DataFrame) -> DataFrame:
    """``origin, reachable``: how many other places each place of ``travel_times`` reaches."""
    return times.groupBy("origin").agg(F.count_if(F.col("origin") != F.col("destination")).alias("reachable"))


def with_connectors(edges: DataFrame, zones: DataFrame, offset: int = 10**12) -> tuple[DataFrame, DataFrame]:
    """Edges and zone nodes of a surface: each connected zone (zone, node, access, population) becomes a node of its own.

    Zone nodes are numbered from ``offset`` in the order of zones, above every node id; the access leg is an edge.
    """
    at = zones.join(dense_ids(zones.select(F.col("zone").alias("node"))).withColumnRenamed("node", "zone"), "zone").withColumn("zone_node", F.col("id") + offset)
    legs = at.where("node is not null").select(F.col("zone_node").alias("u"), F.col("node").alias("v"), F.col("access").alias("cost"))
    return edges.select("u", "v", "cost").unionByName(legs), at.drop("id")


_ACCESS = pa.schema([("zone", pa.int64()), ("accessibility", pa.float64())])


def accessibility(
    edges: DataFrame, zones: DataFrame, tau: float = 30.0, decay: str | Callable[[np.ndarray], np.ndarray] = "exp", origins: DataFrame | None = None, limit: float = float("inf")
) -> DataFrame:
    """``zone, accessibility``: population of all other zones, weighted by ``exp(-minutes / tau)``.

    ``zones``: zone (a node of ``edges``), population (null counts as 0).  The search and the sum run together per
    origin: no table of pairs is made.  ``limit`` cuts the search off (none by default).  ``decay`` is "exp", "power"
    (``minutes ** -tau``, from one minute on) or a function from an array of minutes to weights.  ``origins`` (zone) asks
    for some zones only.  Graphs of more than ``BROADCAST_EDGES`` edges relax in rounds instead.
    """
    named = {"exp": lambda t: np.exp(-t / tau), "power": lambda t: np.maximum(t, 1.0) ** -tau}
    kernel = decay if callable(decay) else named[decay]
    pairs = cut(cheapest(edges))
    graph = compact(pairs)
    zones = zones.select("zone", F.coalesce("population", F.lit(0.0)).cast("double").alias("population"))
    wanted = (zones if origins is None else origins).select("zone").distinct()
    if graph is None or zones.count() > BROADCAST_EDGES:
        ways = shortest_paths(pairs, wanted.select(F.col("zone").alias("node")), limit, broadcast=False)
        weight = F.pandas_udf(lambda t: pd.Series(kernel(t.to_numpy())), "double")("dist")
        if not callable(decay):
            weight = F.exp(-F.col("dist") / tau) if decay == "exp" else F.pow(F.greatest("dist", F.lit(1.0)), F.lit(-tau))
        got = ways.where("origin <> node").join(zones.select(F.col("zone").alias("node"), "population"), "node")
        got = got.groupBy(F.col("origin").alias("zone")).agg(F.sum(F.col("population") * weight).alias("accessibility"))
        return wanted.join(got, "zone", "left").na.fill(0.0, ["accessibility"])
    z = zones.toPandas()
    people = np.zeros(len(graph.ids))
    place = np.searchsorted(graph.ids, z["zone"].to_numpy())
    inside = place < len(graph.ids)
    inside[inside] = graph.ids[place[inside]] == z["zone"].to_numpy()[inside]
    np.add.at(people, place[inside], z["population"].to_numpy()[inside])
    shared = edges.sparkSession.sparkContext.broadcast((graph, people))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, p = shared.value
        for b in batches:
            out = []
            for o in b.column(0).to_pylist():
                k = int(np.searchsorted(g.ids, o))
                if k == len(g.ids) or g.ids[k] != o:
                    out.append(0.0)
                    continue
                at, dist, *_ = g.search([k], limit)
                other = at != k
                out.append(float((p[at[other]] * kernel(dist[other])).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], schema=_ACCESS)

    return wanted.select(F.col("zone").cast("long").alias("zone")).repartition("zone").mapInArrow(run, "zone long, accessibility double")


def approximate_accessibility(edges: DataFrame, zones: DataFrame, radius: float = 10.0, tau: float = 30.0, horizon: float = float("inf")) -> DataFrame:
    """Two-level estimate: exact within ``radius`` minutes; beyond it, zones count at their cluster's centre.

    Clusters are the zones nearest to centres, which are picked so that no two are within ``radius`` (smallest id first).
    Only centres meet centres, up to ``horizon`` minutes apart.
    """
    pairs = cut(cheapest(edges))
    near = cut(shortest_paths(pairs, zones.select(F.col("zone").alias("node")), 2 * radius).where("node is not null"))
    links = near.where(F.col("dist") <= radius).join(zones.select(F.col("zone").alias("node")), "node", "left_semi").select("origin", "node")
    # centres: zones that are the smallest of all zones within the radius; the rest joins its nearest centre
    least = links.groupBy("origin").agg(F.min("node").alias("first"))
    centres = cut(least.where("origin = first").select(F.col("origin").alias("node")))
    to_centre = near.join(centres, "node", "left_semi").groupBy(F.col("origin").alias("zone")).agg(F.min(F.struct("dist", "node")).alias("b"))
    of_zone = cut(zones.join(to_centre, "zone", "left").select("zone", "population", F.coalesce("b.node", "zone").alias("centre"), F.coalesce("b.dist", F.lit(0.0)).alias("leg")))
    clusters = of_zone.groupBy("centre").agg(F.sum("population").alias("population"))
    between = cut(shortest_paths(pairs, of_zone.select(F.col("centre").alias("node")), horizon).select(F.col("origin").alias("centre"), F.col("node").alias("other"), "dist"))
    close = near.where(F.col("dist") <= radius).select(F.col("origin").alias("zone"), F.col("node").alias("z"), "dist").where("zone <> z")
    close = close.join(of_zone.select(F.col("zone").alias("z"), "population", F.col("centre").alias("other")), "z")
    exact = close.groupBy("zone").agg(F.sum(F.col("population") * F.exp(-F.col("dist") / tau)).alias("near"))
    own = of_zone.select("zone", F.col("centre").alias("other"), F.col("population").alias("p"))
    counted = close.select("zone", "other", F.col("population").alias("p")).unionByName(own).groupBy("zone", "other").agg(F.sum("p").alias("counted"))
    # what a centre sees is summed once; zones take off what they count exactly, and weigh the rest by their own leg
    weight = F.exp(-F.col("dist") / tau)
    seen = between.join(clusters.select(F.col("centre").alias("other"), "population"), "other").groupBy("centre").agg(F.sum(F.col("population") * weight).alias("seen"))
    off = counted.join(of_zone.select("zone", "centre"), "zone").join(between, ["centre", "other"]).groupBy("zone").agg(F.sum(F.col("counted") * weight).alias("off"))
    far = of_zone.select("zone", "centre", "leg").join(seen, "centre").join(off, "zone", "left")
    far = far.select("zone", ((F.col("seen") - F.coalesce("off", F.lit(0.0))) * F.exp(-F.col("leg") / tau)).alias("far"))
    return zones.select("zone").join(exact, "zone", "left").join(far, "zone", "left").select("zone", (F.coalesce("near", F.lit(0.0)) + F.coalesce("far", F.lit(0.0))).alias("accessibility"))


def relative_score(values: DataFrame, column: str = "accessibility", by: list[str] | None = None, q: float = 0.99) -> DataFrame:
    """``score``: ``min(value / q-quantile, 1)`` per group; a missing value stays missing."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    name = free(values, "quantile")
    top = values.groupBy(*(by or [])).agg(F.percentile(x, F.lit(q)).alias(name))
    out = values.join(top, by) if by else values.crossJoin(F.broadcast(top))  # one row
    return out.withColumn("score", F.when(x.isNotNull(), F.least(x / F.col(name), F.lit(1.0)))).drop(name)


def scenario_difference(with_: DataFrame, without: DataFrame, key: str = "zone", q: float = 0.99) -> DataFrame:
    """``(with - without) / q-quantile of without`` for zones in both."""
    top = F.broadcast(without.agg(F.percentile(F.nanvl("accessibility", F.lit(None).cast("double")), F.lit(q)).alias("top")))
    both = with_.select(key, F.col("accessibility").alias("a")).join(without.select(key, F.col("accessibility").alias("b")), key)
    return both.crossJoin(top).select(key, ((F.col("a") - F.col("b")) / F.col("top")).alias("difference"))
