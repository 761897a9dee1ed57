import heapq
import random

import pytest
from pyspark.sql import functions as F

from netspark.operators import components, network, paths

A, P = "absent", "present"
GAPS = [
    ([(1, 2, 5000, P), (2, 3, 120, A), (3, 4, 180, A), (4, 5, 800, P)], [1, 2]),
    ([(1, 2, 5000, P), (2, 3, 200, A), (3, 4, 200, A), (4, 5, 800, P), (1, 6, 50, A)], []),
    ([(1, 2, 5000, P), (2, 3, 100, A), (2, 4, 250, A), (3, 5, 800, P), (4, 5, 10, P)], [1]),
]
CUTS = [
    ([(1, 2, 1000, P), (2, 3, 150, A), (3, 4, 1000, P), (1, 5, 3000, P), (5, 4, 3000, P)], [1]),
    ([(1, 2, 1000, P), (2, 3, 150, A), (3, 4, 1000, P), (2, 5, 500, P), (5, 3, 500, P)], []),
    ([(1, 2, 1000, P), (2, 6, 200, A), (6, 3, 200, A), (3, 4, 1000, P), (1, 5, 3000, P), (5, 4, 3000, P)], []),
    ([(1, 2, 1000, P), (2, 3, 150, A), (3, 4, 1000, P), (1, 5, 3000, P), (5, 4, 3000, P), (3, 6, 900, A)], [1]),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge long, u long, v long, length_m double, status string".replace("double", "long")).withColumn("length_m", F.col("length_m").cast("double"))


@pytest.mark.parametrize("rows,want", GAPS)
def test_gaps(spark, rows, want):
    assert sorted(r.edge for r in network.bridge_gaps(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("rows,want", CUTS)
def test_cuts(spark, rows, want):
    assert sorted(r.edge for r in network.bridge_cuts(frame(spark, rows)).collect()) == want


def random_graph(seed, n=40, m=70):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), float(rng.randint(1, 9))) for _ in range(m)]


def dijkstra(edges, start):
    near = {}
    for u, v, c in edges:
        near.setdefault(u, []).append((v, c))
        near.setdefault(v, []).append((u, c))
    dist, heap = {}, [(0.0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in dist:
            dist[x] = d
            for y, c in near.get(x, []):
                heapq.heappush(heap, (d + c, y))
    return dist


@pytest.mark.parametrize("broadcast", [True, False])
def test_shortest_paths(spark, broadcast):
    edges = random_graph(1)
    df = spark.createDataFrame(edges, "u long, v long, cost double")
    got = paths.shortest_paths(df, spark.createDataFrame([(0,), (7,), (999,)], "node long"), broadcast=broadcast).collect()
    for o in (0, 7):
        assert {r.node: r.dist for r in got if r.origin == o} == dijkstra(edges, o)
    assert [(r.node, r.dist) for r in got if r.origin == 999] == [(999, 0.0)]


def test_both_forms_agree_on_parents(spark):
    df = spark.createDataFrame(random_graph(2, 25, 60), "u long, v long, cost double")
    o = spark.createDataFrame([(3,)], "node long")
    a, b = (sorted(map(tuple, paths.shortest_paths(df, o, 12.0, broadcast=x).select("node", "dist", "parent").collect())) for x in (True, False))
    assert a == b


def test_components(spark):
    edges = random_graph(3, 200, 150)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long, c double")).collect()}
    root = {}
    for u, v, _ in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v, _ in edges:
            m = min(root[u], root[v])
            if root[u] != m or root[v] != m:
                root[u] = root[v] = m
                changed = True
    assert got == root


def test_bfs_and_trace(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (8, 9)], "u long, v long")
    got = {r.node: (r.depth, r.parent) for r in paths.bfs(links, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {1: (0, None), 2: (1, 1), 4: (1, 1), 3: (2, 2), 5: (3, 3)}


def test_accessibility(spark):
    edges = random_graph(4, 30, 60)
    df = spark.createDataFrame(edges, "u long, v long, cost double")
    zones = spark.createDataFrame([(i, float(i)) for i in range(0, 30, 3)], "zone long, population double")
    import math

    got = {r.zone: r.accessibility for r in network.accessibility(df, zones).collect()}
    for z in got:
        want = sum(d_zone * math.exp(-t / 30) for y, t in dijkstra(edges, z).items() if y != z and y % 3 == 0 and (d_zone := float(y)))
        assert abs(got[z] - want) < 1e-9
    about = {r.zone: r.accessibility for r in network.approximate_accessibility(df, zones, radius=3.0).collect()}
    assert sorted(abs(about[z] / got[z] - 1) for z in got if got[z])[len(got) // 2] < 0.15
    score = network.relative_score(spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, float("nan"))], "zone long, accessibility double"))
    assert {r.zone: r.score for r in score.collect()} == pytest.approx({1: 1 / 1.99, 2: 1.0, 3: None, 4: None})


def test_dense_ids(spark):
    got = network.dense_ids(spark.createDataFrame([(i * 7 % 101,) for i in range(300)], "node long")).orderBy("node").collect()
    assert [r.id for r in got] == list(range(len(got)))
