import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netspark.functions import geometry as G
from netspark.operators import spatial
from netspark.operators.components import connected_components


def lines(spark, *geoms):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in g]) for i, g in enumerate(geoms)], f"line_id long, geom {G.LINE}")


@pytest.mark.parametrize(
    "second,connectors,n,pieces",
    [([(500, 30), (500, 600)], 1, 1, 3), ([(500, 60), (500, 600)], 0, 2, 2), ([(500, -500), (500, 500)], 0, 1, 4)],
)
def test_snap_and_split(spark, second, connectors, n, pieces):
    out = spatial.snap_ends(lines(spark, [(0, 0), (1000, 0)], second)).cache()
    assert out.where("is_connector").count() == connectors and out.where("not is_connector").count() == pieces
    nodes, edges = spatial.graph_of(out)
    labels = connected_components(edges)
    assert labels.select("component").distinct().count() == n


def points(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double")


def test_distance_joins(spark):
    (ra, a), (rb, b) = points(spark, 1, 60), points(spark, 2, 70)
    d = lambda p, q: math.hypot(p[1] - q[1], p[2] - q[2])
    got = {(r.a_id, r.b_id) for r in spatial.within_distance(a, b, 9.0).collect()}
    assert got == {(p[0], q[0]) for p in ra for q in rb if d(p, q) <= 9}
    near = {r.a_id: r.b_id for r in spatial.nearest(a, b, 9.0).collect()}
    best = {p[0]: min(rb, key=lambda q: d(p, q)) for p in ra}
    assert near == {k: q[0] for k, q in best.items() if d(ra[k], q) <= 9}
    back = {q[0]: min(ra, key=lambda p: d(p, q))[0] for q in rb}
    assert {(r.a_id, r.b_id) for r in spatial.mutual_nearest(a, b, 9.0).collect()} == {(k, v) for k, v in near.items() if back[v] == k}


def test_polygons_boxes_and_lines(spark):
    rp, p = points(spark, 3, 200)
    hole = [[(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], [(10, 10), (20, 10), (20, 20), (10, 20), (10, 10)]]
    poly = spark.createDataFrame([(1, [[tuple(map(float, q)) for q in r] for r in hole])], f"polygon_id long, polygon {G.LINES}")
    want = {i for i, x, y in rp if 0 <= x < 40 and 0 <= y < 40 and not (10 <= x < 20 and 10 <= y < 20)}
    assert {r.id for r in spatial.points_in_polygons(p, poly, 7.0).collect()} == want
    assert poly.select(G.area("polygon")).first()[0] == 1500
    boxes = spark.createDataFrame([(i, x, y, x + abs(y) / 5, y + abs(x) / 5) for i, x, y in rp[:60]], "id long, xmin double, ymin double, xmax double, ymax double")
    rows = boxes.collect()
    meet = {(a.id, b.id) for a in rows for b in rows if a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax}
    got = spatial.boxes_meet(boxes, boxes, 6.0).collect()
    assert len(got) == len(meet) and {(r.a_id, r.b_id) for r in got} == meet
    l = lines(spark, [(-50, 0), (0, 10), (50, 0)])
    xy = np.array([(-50, 0), (0, 10), (50, 0)], float)
    for r in spatial.points_near_lines(p, l, 8.0).collect():
        at, dist = G.project(xy, np.array(rp[r.id][1:]))
        assert r.dist == pytest.approx(dist) and r.at == pytest.approx(at)


def test_kernels():
    xy = np.array([(0, 0), (3, 4), (3, 10)], float)
    assert G.along(xy).tolist() == [0, 5, 11]
    assert G.interpolate(xy, [5.0]).tolist() == [[3, 4]] and len(G.equal_pieces(xy, 4)) == 3
    assert G.is_simple(xy) and not G.is_simple(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)) and not G.is_simple(np.array([(0, 0), (2, 0), (1, 0)], float))
    square = [np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)]
    assert [p.tolist() for p in G.clip(np.array([(-2, 2), (6, 2)], float), square)] == [[[0, 2], [4, 2]]]
    assert G.inner_point(square)[0] == 2 and G.hausdorff(xy, xy + [0, 1]) <= 1
    assert G.thin(np.array([(0, 0), (0.1, 0), (1, 0)])).tolist() == [[0, 0], [1, 0]]


def tile(i, x, y, s=500.0):
    return (i, x, y, x + s, y + s)


def test_seams(spark):
    t = spark.createDataFrame([tile("a", 0.0, 0.0), tile("b", 500.0, 0.0), tile("c", 500.0, 500.0)], "tile_id string, xmin double, ymin double, xmax double, ymax double")
    assert {(r.tile_a, r.tile_b) for r in spatial.shared_edges(t).collect()} == {("a", "b"), ("b", "c")}
    sliver = spark.createDataFrame([("a", 0.0, 0.0, 500.000000001, 500.0), tile("b", 500.0, 0.0)], t.schema)
    e = spatial.shared_edges(sliver).first()
    assert abs(e.y2 - e.y1 - 500) < 0.1
    road = lambda i, f, *g: (i, f, [tuple(map(float, p)) for p in g])
    r = spark.createDataFrame([road("a", "a1", (10, 100), (495, 100)), road("b", "b1", (508, 102), (900, 102)), road("a", "a2", (10, 300), (490, 300))], f"tile_id string, product_feature_id string, geom {G.LINE}")
    joins, gaps = spatial.stitch(t, r)
    assert [(x.feature_a, x.feature_b) for x in joins.collect()] == [("a1", "b1")]
    assert [(x.feature, x.end, x.neighbour) for x in gaps.collect()] == [("a2", "end", "b")]
    far = spark.createDataFrame([road("a", "a1", (10, 100), (495, 100)), road("b", "b1", (505, 145), (900, 145))], r.schema)
    joins, gaps = spatial.stitch(t, far)
    assert joins.count() == 0 and gaps.count() == 2


def test_diagonals_take_few_buckets(spark):
    s = spark.createDataFrame([(0.0, 0.0, 1000.0, 1000.0), (5.0, 5.0, 5.0, 995.0), (3.0, 3.0, 3.0, 3.0), (-50.0, 40.0, 60.0, -70.0)], "x1 double, y1 double, x2 double, y2 double")
    for reach in (0.0, 10.0):
        got = spatial.segment_cells(s.withColumn("i", F.monotonically_increasing_id()), 10.0, reach).groupBy("x1", "y1").count().collect()
        assert max(r["count"] for r in got) < 1000
        cells = {(r.x1, r.cx, r.cy) for r in spatial.segment_cells(s, 10.0, reach).collect()}
        rng = random.Random(1)
        for x1, y1, x2, y2 in s.collect():
            for _ in range(300):
                t, a = rng.random(), rng.uniform(0, 2 * math.pi)
                x, y = x1 + t * (x2 - x1) + reach * 0.999 * math.cos(a), y1 + t * (y2 - y1) + reach * 0.999 * math.sin(a)
                assert (x1, math.floor(x / 10), math.floor(y / 10)) in cells


def test_shapes_that_meet():
    box = lambda x, y, s: [np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)]
    assert G.polygons_meet(box(0, 0, 4), box(4, 4, 2)) and G.polygons_meet(box(0, 0, 9), box(3, 3, 1)) and not G.polygons_meet(box(0, 0, 4), box(4.1, 0, 2))
    ring = [*box(0, 0, 10), *box(2, 2, 6)]
    assert not G.polygons_meet(ring, box(4, 4, 1)) and G.polygons_meet(ring, box(1, 1, 2))
    d, p, q = G.nearest_points(np.array([(0, 0), (10, 0)], float), np.array([(4, 3), (4, 9)], float))
    assert d == 3 and p.tolist() == [4, 0] and q.tolist() == [4, 3]
    assert G.nearest_points(np.array([(0, 0), (10, 0)], float), np.array([(4, -3), (4, 9)], float))[0] == 0


def test_long_lines_are_cut_in_batches(spark, monkeypatch):
    """Batches hold so many pieces, whatever the lines' lengths; null and empty lines have none."""
    lines = [(1, [(0.0, 0.0), (3.0, 0.0), (3.0, 0.0), (3.0, 4000.0)], 7), (2, [(0.0, 0.0), (0.0, 25.0)], 8), (3, None, 9), (4, [], 9), (5, [(1.0, 1.0), (1.0, 1.0)], 9)]
    df = spark.createDataFrame(lines, "line_id long, geom array<struct<x:double,y:double>>, tag int")
    got = spatial.build_edges(df, 10.0, keep=("tag",)).orderBy("line_id", "piece").collect()
    assert [sum(r.line_id == i for r in got) for i in range(1, 6)] == [401, 3, 0, 0, 1]
    assert {(r.line_id, r.tag) for r in got} == {(1, 7), (2, 8), (5, 9)} and got[0].edge_id == "1_0_0"
    assert all(abs(r.length_m - (4003 / 401 if r.line_id == 1 else 25 / 3 if r.line_id == 2 else 0)) < 1e-9 for r in got)
    assert [tuple(p) for p in got[0].geom[:3]] == [(0.0, 0.0), (3.0, 0.0), (3.0, 0.0)]
    as_given = SimpleNamespace(schema=df.drop("tag").schema, columns=["line_id", "geom"], mapInArrow=lambda run, _: run)
    batch = df.drop("tag").toArrow().to_batches()
    sizes = [x.num_rows for x in G.split_equal(as_given, 10.0, at_once=64)(batch)]
    assert sum(sizes) == 405 and max(sizes) <= 64
    points = df.where("line_id < 3").select(G.segmentised("geom", F.lit(4.0)).alias("p")).collect()
    assert [len(r.p) for r in points] == [1 + 1 + 1000 + 1, 8] and points[1].p[1].y == 25 / 7
