"""Registered queries of graphs, answers, evidence and whole runs, over chains and squares made of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netspark.functions import answers as A
from netspark.functions import geometry as G
from netspark.more_queries import _N, _line, _nations, _p, _square
from netspark.operators import evidence, matched, national, network, paths, places, repair, reviews, search
from netspark.plans.iterate import cut
from netspark.queries import _WAYS, _roads, query

# ---- graphs


@query(f"{_WAYS} SELECT o::BIGINT AS origin, d::BIGINT AS node, round(t, 6) AS dist FROM sp WHERE t <= 18")
def bounded_shortest_paths(t):
    roads = _roads(t)
    origins = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("node"))
    return paths.shortest_paths(roads, origins, 18.0, broadcast=False).select("origin", "node", F.round("dist", 6).alias("dist"))


@query(f"""{_WAYS}, s AS (SELECT min(u) AS o FROM g), f AS (SELECT sp.d, sp.t FROM sp, s WHERE sp.o = s.o),
    up AS (SELECT f.d AS node, (SELECT min(b.a) FROM b JOIN f p ON p.d = b.a WHERE b.b = f.d AND abs(p.t + b.cost - f.t) < 1e-9) AS parent FROM f)
    SELECT node::BIGINT AS node, parent::BIGINT AS parent FROM up""")
def traced_back(t):
    roads = cut(_roads(t))
    start = paths.symmetric(roads.select("u", "v")).agg(F.min("u").alias("node")).where("node is not null")
    tree = cut(paths.shortest_paths(roads, start))
    return paths.trace(tree.drop("origin"), tree.select("node")).select("node", "parent")


@query(f"""{_WAYS}, z AS (SELECT DISTINCT u AS k FROM g UNION SELECT v FROM g)
    SELECT 1000 + o::BIGINT AS origin, 1000 + d::BIGINT AS destination, round(CASE WHEN o = d THEN 0 ELSE t + o % 3 + d % 3 END, 6) AS minutes FROM sp WHERE o IN (SELECT k FROM z) AND d IN (SELECT k FROM z)""")
def travel_times_with_access(t):
    roads = cut(_roads(t))
    at = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("node")).distinct()
    at = at.select((F.col("node") + 1000).alias("place"), "node", (F.col("node") % 3).cast("double").alias("access"))
    return network.travel_times(roads, at).withColumn("minutes", F.round("minutes", 6))


@query(f"{_WAYS} SELECT o::BIGINT AS place, count(*) FILTER (o <> d) AS reachable FROM sp GROUP BY 1")
def reachable_places(t):
    roads = cut(_roads(t))
    at = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("node")).distinct().select(F.col("node").alias("place"), "node", F.lit(0.0).alias("access"))
    return network.reachable(network.travel_times(roads, at)).withColumnRenamed("origin", "place")


@query(f"""{_WAYS}, p AS (SELECT c_nationkey AS z, count(*)::DOUBLE AS pop FROM customer GROUP BY 1)
    SELECT o::BIGINT AS zone, round(sum(pop * CASE WHEN t <= 15 THEN 1 ELSE 0 END), 4) AS accessibility FROM sp JOIN p ON p.z = d WHERE o <> d AND o % 2 = 0 GROUP BY 1""")
def accessibility_of_some_by_a_given_decay(t):
    roads = cut(_roads(t))
    zones = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("zone")).agg(F.count("*").cast("double").alias("population"))
    known = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("zone")).distinct()
    some = known.where("zone % 2 = 0")
    out = network.accessibility(roads, zones, decay=lambda m: (m <= 15).astype(float), origins=some)
    has_other = zones.join(some, "zone", "left_semi").select("zone").unionByName(some).distinct()
    return out.join(has_other, "zone", "left_semi").select("zone", F.round("accessibility", 4).alias("accessibility"))


@query("SELECT true AS close, true AS whole, true AS differs")
def approximate_accessibility(t):
    """On a chain whose first links are short: the estimate lies within 5 % for the median zone, 20 % for every zone, has
    every zone, and is an estimate (some zones are clustered)."""
    edges, _ = _period(t)
    e = cut(edges.where("mode = 'road'").select("u", "v", F.col("cost_min").alias("cost")))
    zones = _nations(t).select(F.col("k").alias("zone"), ((F.col("k") + 1) * 10.0).alias("population"))
    a = cut(network.approximate_accessibility(e, zones, radius=3.0).withColumnRenamed("accessibility", "about"))
    b = cut(network.accessibility(e, zones).join(a, "zone", "full"))
    off = F.abs(F.col("about") / F.col("accessibility") - 1)
    return b.agg(((F.median(off) < 0.05) & (F.max(off) < 0.2)).alias("close"), (F.count_if(F.col("about").isNull() | F.col("accessibility").isNull()) == 0).alias("whole"), (F.max(off) > 1e-9).alias("differs"))


def _edges(n: DataFrame, *rows: tuple) -> DataFrame:
    """Edges of fixtures: (id, u, v, metres, status) as SQL of k, for every row of ``n``."""
    parts = F.array(*(F.struct(F.expr(str(e)).cast("long").alias("edge"), F.expr(str(u)).cast("long").alias("u"), F.expr(str(v)).cast("long").alias("v"), F.expr(str(m)).cast("double").alias("length_m"), F.lit(s).alias("status")) for e, u, v, m, s in rows))
    return n.select(F.explode(parts).alias("e")).select("e.*").dropDuplicates(["edge"])


@query(f"SELECT k * 10 + 1 AS edge FROM {_N} WHERE k * 25 <= 300 UNION ALL SELECT k * 10 + 4 FROM {_N} WHERE k * 25 > 300 AND k * 12 + 1 <= 290")
def bridged_gaps(t):
    """A long road, and a stranded fragment per nation: one direct absent link, and one in two parts."""
    e = _edges(
        _nations(t), ("-1", "-1", "-2", "1000000", "present"), ("k * 10", "-1000 - k * 10", "-1001 - k * 10", "800", "present"),
        ("k * 10 + 1", "-1", "-1000 - k * 10", "k * 25", "absent"), ("k * 10 + 4", "-2", "-1001 - k * 10", "if(k * 25 > 300, k * 12 + 11, 5000)", "absent"),
    )
    return network.bridge_gaps(e, 300.0)


@query(f"SELECT k * 10 + 1 AS edge FROM {_N} WHERE k * 20 <= 300 AND k % 2 = 0")
def bridged_cuts(t):
    """Per nation an absent link between two ends of a long way round, or of a short one."""
    n = "k * 100"
    e = _edges(
        _nations(t), ("k * 10", n, f"{n} + 1", "1000", "present"), ("k * 10 + 1", f"{n} + 1", f"{n} + 2", "k * 20", "absent"), ("k * 10 + 2", f"{n} + 2", f"{n} + 3", "1000", "present"),
        ("k * 10 + 3", n, f"{n} + 4", "if(k % 2 = 0, 3000, 10)", "present"), ("k * 10 + 4", f"{n} + 4", f"{n} + 3", "if(k % 2 = 0, 3000, 10)", "present"),
        ("k * 10 + 5", f"{n} + 1", f"{n} + 5", "if(k % 2 = 0, 9000, 500)", "present"), ("k * 10 + 6", f"{n} + 5", f"{n} + 2", "if(k % 2 = 0, 9000, 500)", "present"),
    )
    return network.bridge_cuts(e, 300.0, 2000.0)


def _chain(t, length) -> DataFrame:
    """Links of neighbouring cells of one row of cells per nation: region, u, v."""
    c = _nations(t).select(F.col("k").alias("region"), F.explode(F.sequence(F.lit(0).cast("long"), length - 1)).alias("ix"))
    cell = lambda x: (x * search.PACK + F.col("region")).cast("long")
    return c.select("region", cell(F.col("ix")).alias("u"), cell(F.col("ix") + 1).alias("v"))


@query(f"SELECT k AS region, i * 100000 + k AS cell, i IN (2, k % 7 + 3) AS reached FROM {_N}, LATERAL (SELECT unnest(range(k % 7 + 4)) AS i)")
def goal_directed_search(t):
    links = _chain(t, F.col("k") % 7 + 5)
    n = _nations(t)
    start = n.select(F.col("k").alias("region"), F.col("k").alias("cell"))
    goals = n.select(F.col("k").alias("region"), F.explode(F.array((F.col("k") % 7 + 3) * search.PACK + F.col("k"), 2 * search.PACK + F.col("k")).cast("array<bigint>")).alias("cell")).withColumn("depth", F.col("cell"))
    return search.goal_directed(links, start, goals)


@query(f"SELECT i * 100000 + k AS node FROM {_N}, LATERAL (SELECT unnest(range(k % 7 + 3)) AS i)")
def lower_bound_cells(t):
    n = _nations(t)
    goals = n.select(((F.col("k") % 7 + 2) * search.PACK + F.col("k")).cast("long").alias("node"))
    return search.lower_bound(_chain(t, F.col("k") % 7 + 5).select("u", "v"), n.select(F.col("k").alias("node")), goals)


@query(f"SELECT i * 100000 + k AS node, i::INT AS depth FROM {_N}, LATERAL (SELECT unnest(range(least(k % 7 + 5, 4))) AS i)")
def connected_read_cells(t):
    links = _chain(t, F.col("k") % 7 + 5).select("u", "v")
    read = paths.symmetric(links).select(F.col("u").alias("node")).distinct().where(f"floor(node / {search.PACK}) <> 4")
    return search.connected(links, read, _nations(t).select(F.col("k").alias("node")))


@query("""WITH f AS (SELECT DISTINCT c_custkey % 50 AS ix, c_custkey // 50 % 40 AS iy FROM customer), g AS (SELECT s_suppkey % 45 AS gx, s_nationkey AS gy FROM supplier)
          SELECT ix, iy, min(greatest(abs(ix - gx), abs(iy - gy)))::BIGINT AS dist FROM f, g GROUP BY 1, 2 ORDER BY dist, ix, iy LIMIT 12""")
def frontier_cells_nearest_to_a_goal(t):
    f = t.customer.select((F.col("c_custkey") % 50).alias("ix"), (F.floor(F.col("c_custkey") / 50) % 40).alias("iy")).distinct()
    return search.choose(f, t.supplier.select((F.col("s_suppkey") % 45).alias("ix"), F.col("s_nationkey").cast("long").alias("iy")), 12).withColumn("dist", F.col("dist").cast("long"))


@query("SELECT i::BIGINT AS ix, 0::BIGINT AS iy, 'e' AS side FROM range(9) r(i)")
def search_in_rounds(t):
    start = t.spark.range(1).select(F.lit(0).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"))
    goal = t.spark.range(1).select(F.lit(20).cast("long").alias("ix"), F.lit(0).cast("long").alias("iy"))
    found, _ = search.search_rounds(start, goal, lambda c: c.where("ix < 9").withColumn("side", F.lit("e")), 3, 30)
    return found.select("ix", "iy", "side")


# ---- answers


_FEATURE = """concat('{', if(l_linenumber % 2 = 0, '"id"', '"feature_id"'), ':"f', l_linenumber, '","waypoints_uv":[[', cast(l_quantity as int), ',0],[', cast(round(l_discount * 100) as int) * 150, ',', l_linenumber, ']],',
    if(l_returnflag = 'R', '"class":"motorway"', if(l_returnflag = 'A', '"proposed_class":"Single_Line"', '"proposed_class":"dashed_line"')),
    ',"junction_ids":[],"endpoint_flags":', if(l_linestatus = 'O', '["dead_end","obscured"]', '["junction"]'), ',"evidence_note":"seen",', if(l_tax > 0.04, '"colour":"red",', ''), '"uncertainty_note":""}')"""


def _answers(t) -> DataFrame:
    """A reading per order: its lines as features; some wrapped, some of another tile, some no JSON."""
    f = t.lineitem.selectExpr("l_orderkey", "l_linenumber", f"{_FEATURE} as f").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "f"))), lambda x: x["f"]), ",").alias("fs"))
    body = F.expr("concat('{\"tile_id\":\"t', if(l_orderkey % 11 = 0, 'x', cast(l_orderkey as string)), '\",\"features\":[', fs, '],\"junctions\":[{\"junction_id\":\"j\",\"uv\":[', l_orderkey % 1200, ',5],\"branch_count\":', l_orderkey % 5, ',\"evidence_note\":\"\"}]}')")
    text = F.when(F.col("l_orderkey") % 13 == 0, "no object { here").when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return A.documents(f.select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("tile_id"), text.alias("text"))).drop("text")


_L = "(SELECT *, 'f' || l_linenumber AS fid, CASE l_returnflag WHEN 'A' THEN 'single_line' WHEN 'N' THEN 'dashed_line' ELSE 'unknown' END AS cls, round(l_discount * 100)::INT * 150 AS far FROM lineitem WHERE l_orderkey % 13 <> 0)"


@query(f"""SELECT 't' || l_orderkey AS tile_id, fid AS feature_id, cls AS proposed_class, CASE l_returnflag WHEN 'A' THEN 'Single_Line' WHEN 'N' THEN 'dashed_line' ELSE 'motorway' END AS raw, far::DOUBLE AS far,
           CASE WHEN l_linestatus = 'O' THEN 'dead_end,unknown' ELSE 'junction' END AS flags, CASE WHEN l_tax > 0.04 THEN '{{"colour":"red"}}' END AS extra FROM {_L}""")
def features_of_answers(t):
    f = A.features(_answers(t))
    return f.select("tile_id", "feature_id", "proposed_class", F.col("proposed_class_raw").alias("raw"), F.col("waypoints_uv")[1][0].alias("far"), F.array_join("endpoint_flags", ",").alias("flags"), "extra")


@query(f"""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), j AS (SELECT * FROM o WHERE k % 13 <> 0),
    again AS (SELECT l_orderkey, fid, row_number() OVER (PARTITION BY l_orderkey, fid ORDER BY l_linenumber) AS nth FROM {_L})
    SELECT scope, kind, n FROM (
    SELECT 'top' AS scope, 'no_json_object' AS kind, count(*) AS n FROM o WHERE k % 13 = 0 UNION ALL SELECT 'top', 'answer_not_bare_json', count(*) FROM j WHERE k % 5 = 0 UNION ALL SELECT 'top', 'tile_id_mismatch', count(*) FROM j WHERE k % 11 = 0
    UNION ALL SELECT 'feature', 'renamed_key', count(*) FILTER (l_linenumber % 2 = 0) + count(*) FILTER (l_returnflag = 'R') FROM {_L} UNION ALL SELECT 'feature', 'extra_key', count(*) FROM {_L} WHERE l_tax > 0.04
    UNION ALL SELECT 'feature', 'class_not_in_vocabulary', count(*) FROM {_L} WHERE l_returnflag = 'R' UNION ALL SELECT 'feature', 'class_case_normalised', count(*) FROM {_L} WHERE l_returnflag = 'A'
    UNION ALL SELECT 'feature', 'endpoint_flag_not_in_vocabulary', count(*) FROM {_L} WHERE l_linestatus = 'O' UNION ALL SELECT 'feature', 'wrong_type', count(*) FROM {_L} WHERE l_linestatus <> 'O'
    UNION ALL SELECT 'feature', 'coordinate_out_of_range', count(*) FROM {_L} WHERE far > 1000 UNION ALL SELECT 'feature', 'duplicate_feature_id', count(*) FROM again WHERE nth > 1
    UNION ALL SELECT 'junction', 'renamed_key', count(*) FROM j UNION ALL SELECT 'junction', 'coordinate_out_of_range', count(*) FROM j WHERE k % 1200 > 1000 UNION ALL SELECT 'junction', 'value_out_of_range', count(*) FROM j WHERE k % 5 < 3) WHERE n > 0""")
def deviations_of_answers(t):
    return A.deviations(_answers(t), A.PASS_A).groupBy("scope", "kind").agg(F.count("*").alias("n"))


@query("SELECT 't' || k AS tile_id, 'j' AS junction_id, CASE WHEN k % 5 >= 0 THEN k % 5 END AS n_branches, 2.0 * (k % 1200) + 7 AS x FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) WHERE k % 13 <> 0 AND k % 1200 <= 1000")
def junctions_of_answers(t):
    j = reviews.junction_points(_answers(t), (2.0, 0.0, 7.0, 0.0, -2.0, 0.0))
    return j.select("tile_id", "junction_id", "n_branches", F.col("point.x").alias("x"))


_VERDICT = "CASE c_custkey % 7 WHEN 0 THEN 'agree' WHEN 1 THEN 'agree_with_different_class' WHEN 2 THEN 'partly_agree_course_differs' WHEN 3 THEN 'partly_agree_course_differs' WHEN 4 THEN 'disagree_not_a_road' WHEN 5 THEN 'perhaps' ELSE '' END"


def _reviewed(t) -> DataFrame:
    """A tile per nation: a line per customer, a review of most of them, a line of the reviewer's own."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"))
    line = lambda name, y: f"""concat('{{"feature_id":"{name}', c_custkey, '","waypoints_uv":[[10,', {y}, '],[', 20 + c_custkey % 900, ',', {y}, ']],"proposed_class":"single_line","junction_ids":[],"endpoint_flags":["dead_end","dead_end"],"evidence_note":"","uncertainty_note":""}}')"""
    review = f"""concat('{{"reviewed_feature_id":"c', c_custkey, '","verdict":"', {_VERDICT}, '","evidence_note":"e"', if(c_custkey % 7 = 1, ',"proposed_class":"dashed_line"', ''), if(c_custkey % 7 = 2, concat(',"corrected_waypoints_uv":[[10,', c_custkey % 900 + 5, '],[500,', c_custkey % 900 + 5, ']]'), ''), '}}')"""
    listed = lambda e, cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.expr(cond), F.struct("c_custkey", F.expr(e).alias("x"))))), lambda s: s["x"]), ",")
    g = c.groupBy("k").agg(listed(line("c", "c_custkey % 900"), "true").alias("fs"), listed(review, "c_custkey % 7 < 6").alias("rs"), listed(line("m", "950"), "c_custkey % 7 = 6").alias("ms"))
    tile = F.concat(F.lit("t"), F.col("k").cast("string"))
    a = F.concat(F.lit('{"tile_id":"'), tile, F.lit('","junctions":[],"features":['), "fs", F.lit("]}"))
    b = F.concat(F.lit('{"tile_id":"'), tile, F.lit('","contested_junctions":[{"what_is_contested":"position","uv":[1,2],"evidence_note":""}],"features":['), "ms", F.lit('],"reviews":['), "rs", F.lit("]}"))
    return g.select(tile.alias("tile_id"), a.alias("pass_a"), F.when(F.col("k") % 6 == 5, "{}").otherwise(b).alias("pass_c"), "k")


def _products(t) -> dict[str, DataFrame]:
    rows = cut(_reviewed(t))
    tiles = rows.select("tile_id", F.lit(1000.0).alias("display_w"), F.lit(1000.0).alias("display_h"))
    return reviews.tile_products(rows.drop("k"), tiles, "reader", "reviewer", {k: "x" for k in A.PROVENANCE_FIELDS})


_C = "(SELECT *, c_custkey % 7 AS m, 't' || c_nationkey AS tile_id FROM customer WHERE c_nationkey % 6 <> 5)"


@query(f"""SELECT tile_id || ':reader:c' || c_custkey AS product_feature_id, CASE m WHEN 0 THEN 'pass_a_kept_agreed' WHEN 1 THEN 'pass_a_kept_class_contested' ELSE 'course_corrected_by_reviewer' END AS kind, CASE m WHEN 2 THEN 'reviewer' ELSE 'reader' END AS geometry_from,
           m = 1 AS class_contested, 'track_path' AS coarse_class, CASE m WHEN 2 THEN 490 ELSE 10 + c_custkey % 900 END::DOUBLE AS length_m FROM {_C} WHERE m <= 2
           UNION ALL SELECT tile_id || ':reviewer:m' || c_custkey, 'added_by_reviewer', 'reviewer', false, 'track_path', (10 + c_custkey % 900)::DOUBLE FROM {_C} WHERE m = 6""")
def reviewed_product(t):
    p = _products(t)["product"]
    return p.select("product_feature_id", F.col("provenance_kind").alias("kind"), "geometry_from", "class_contested", "coarse_class", F.round("length_m", 6).alias("length_m"))


@query(f"""SELECT 'excluded' AS what, 'c' || c_custkey AS feature_id, CASE m WHEN 3 THEN 'course_differs_but_no_correction_given' WHEN 4 THEN 'reviewer_says_not_a_road' WHEN 5 THEN 'reviewer_cannot_tell' ELSE 'no_review_returned' END AS reason FROM {_C} WHERE m >= 3
           UNION ALL SELECT 'deviation', 'c' || c_custkey, CASE m WHEN 3 THEN 'correction_missing' ELSE 'verdict_not_in_vocabulary' END FROM {_C} WHERE m IN (3, 5)
           UNION ALL SELECT 'deviation', 'cj00', 'renamed_key' FROM (SELECT DISTINCT tile_id FROM {_C})""")
def left_out_and_deviations(t):
    out = _products(t)
    return out["excluded"].select(F.lit("excluded").alias("what"), "feature_id", "reason").unionByName(out["deviations"].select(F.lit("deviation").alias("what"), F.col("object_id").alias("feature_id"), F.col("kind").alias("reason")))


@query("""SELECT 'f' || c_custkey AS feature_id, CASE c_custkey % 9 WHEN 0 THEN 'missing_fields:evidence_note' WHEN 1 THEN 'unknown_tile_id' WHEN 2 THEN $$pass_not_in_('A', 'B', 'C')$$ WHEN 3 THEN 'class_not_in_vocabulary' WHEN 4 THEN 'endpoint_flag_not_in_vocabulary'
          WHEN 5 THEN 'coordinate_outside_map_face' WHEN 6 THEN 'zero_length' WHEN 7 THEN 'self_intersection' ELSE 'accepted' END AS reason FROM customer UNION ALL SELECT 'f' || c_custkey, 'duplicate_feature_id' FROM customer WHERE c_custkey % 9 NOT IN (0, 1) AND c_custkey % 18 = 8""")
def candidates_validated(t):
    m = F.col("c_custkey") % 9
    pt = lambda *ps: F.array(*(F.array(*(F.lit(float(v)) for v in p)) for p in ps))
    way = F.when(m == 5, pt((0, 0), (1001, 0))).when(m == 6, pt((1, 1), (1, 1))).when(m == 7, pt((0, 0), (2, 2), (2, 0), (0, 2))).otherwise(pt((0, 0), (5, 5)))
    c = t.customer.select(
        F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("feature_id"), F.when(m == 1, "nowhere").otherwise("t").alias("tile_id"), F.lit(0).alias("ord"), F.when(m == 2, "D").otherwise("A").alias("pass"), F.lit("x").alias("model_family"),
        way.alias("waypoints_uv"), F.when(m == 3, "lane").otherwise("unknown").alias("proposed_class"), F.array().cast("array<string>").alias("junction_ids"), F.array(F.when(m == 4, "nowhere").otherwise("junction")).alias("endpoint_flags"),
        F.when(m != 0, "").alias("evidence_note"), F.lit("").alias("uncertainty_note"), F.create_map(*(F.lit(x) for k in A.PROVENANCE_FIELDS for x in (k, "v"))).alias("provenance"), "c_custkey",
    )
    again = c.where("c_custkey % 18 = 8").withColumn("ord", F.lit(1))
    tiles = t.spark.range(1).select(F.lit("t").alias("tile_id"), F.lit(1000.0).alias("display_w"), F.lit(1000.0).alias("display_h"))
    good, bad = reviews.validate(c.unionByName(again), tiles)
    return good.select("feature_id", F.lit("accepted").alias("reason")).unionByName(bad.select("feature_id", "reason"))


@query("SELECT p_type AS class, count(*) AS n FROM part GROUP BY 1")
def unmapped_classes(t):
    return A.unmapped_classes(t.part, "p_type")


# ---- evidence


def _sheets(t) -> DataFrame:
    """A sheet per nation with a light road between casings, a dark line, or nothing, along its middle."""
    row = lambda j: F.floor(j / 80)
    kind = F.col("k") % 3
    road = lambda y: F.when(y.between(36, 43), 0.95).when(y.between(34, 45), 0.3).otherwise(0.7)
    dark = lambda y: F.when(y.between(39, 40), 0.2).otherwise(0.7)
    grey = F.transform(F.sequence(F.lit(0), F.lit(6399)), lambda j: F.when(kind == 0, road(row(j))).when(kind == 1, dark(row(j))).otherwise(0.7))
    n = _nations(t).select(F.col("n_name").alias("sheet"), F.lit(0).alias("block"), "k", grey.alias("grey"))
    box = {"xmin": 0.0, "ymin": 0.0, "xmax": 80.0, "ymax": 80.0}
    return n.withColumns({c: F.lit(v) for c, v in box.items()} | {"width": F.lit(80), "height": F.lit(80), "bright": F.col("grey")})


def _middle_lines(t) -> DataFrame:
    line = F.when(F.col("k") < 20, _line(("16", "40"), ("64", "40"))).otherwise(_line(("16", "40"), ("26", "40")))
    return _nations(t).select(F.lit("e").alias("edge_id"), F.col("n_name").alias("sheet"), line.alias("geom"))


@query(f"""SELECT n_name AS sheet, CASE k % 3 WHEN 2 THEN 'absent' ELSE 'present' END AS present, CASE WHEN k >= 20 THEN 'low' ELSE CASE k % 3 WHEN 1 THEN 'low' ELSE 'high' END END AS confidence,
           CASE k % 3 WHEN 0 THEN 'major_double_casing' WHEN 1 THEN 'track_or_path' ELSE 'none' END AS hist_class, CASE k % 3 WHEN 2 THEN 0.0 ELSE 1.0 END AS seen FROM {_N}""")
def roads_on_sheets(t):
    out = evidence.score_sheets(_middle_lines(t), _sheets(t).withColumn("style", F.lit("plain")), {"plain": evidence.Style()})
    return out.select("sheet", "present", "confidence", "hist_class", F.col("evidence_score_slack_dark").alias("seen"))


@query(f"SELECT n_name AS sheet, CASE k % 3 WHEN 0 THEN 'present' WHEN 1 THEN 'present' ELSE 'absent' END AS first, CASE WHEN k % 3 = 2 THEN 'absent' END AS second FROM {_N}")
def absent_edges_scored_again(t):
    first = cut(evidence.score(_middle_lines(t), _sheets(t)))
    out = evidence.rescore_absent(first, _middle_lines(t), _sheets(t), reach_m=20.0)
    return out.select("sheet", F.col("present_first").alias("first"), F.col("present_second").alias("second"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN 'realigned' WHEN o_orderstatus = 'F' THEN 'absent' ELSE 'present' END AS present FROM orders")
def realigned_edges(t):
    e = t.orders.select(F.lit("s").alias("sheet"), F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderstatus") == "F", "absent").otherwise("present").alias("present"))
    again = t.orders.select(F.lit("s").alias("sheet"), F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_custkey") % 2 == 0, "present").otherwise("uncertain").alias("present"))
    return evidence.rescored(e, again).select(F.col("edge_id").alias("o_orderkey"), "present")


@query(f"SELECT n_name AS sheet, sr::BIGINT AS sr, sc::BIGINT AS sc, k % 2 = 0 AS ink FROM {_N}, range(2) a(sr), range(3) b(sc)")
def ink_mask(t):
    n = _nations(t).select(F.col("n_name").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("block"), "k")
    n = n.select("sheet", "block", F.lit(0).alias("row0"), (F.col("block") * 25).alias("col0"), F.lit(25).alias("width"), "k")
    n = n.withColumn("grey", F.transform(F.sequence(F.lit(0), F.lit(1249)), lambda j: F.when(F.col("k") % 2 == 0, (j % 2).cast("double")).otherwise(0.5)))
    return evidence.ink_mask(n).select("sheet", "sr", "sc", "ink")


# ---- places, surfaces, runs


def _parishes(t) -> DataFrame:
    """Squares of a kilometre side by side, one a nation, with town points in some."""
    n = _square("k", "k * 1000", "0", "1000", _nations(t)).withColumnRenamed("polygon_id", "k")
    name = F.concat(F.lit("PLACE-"), F.col("k").cast("string"))
    town = _square("k", "k * 1000 + 200", "200", "100", _nations(t).where("k % 5 = 0")).withColumnRenamed("polygon_id", "k")
    parish = n.select(F.concat(F.lit("p"), F.col("k").cast("string")).alias("place"), name.alias("name"), F.lit("parish").alias("level"), "polygon", "k")
    towns = town.select(F.concat(F.lit("s"), F.col("k").cast("string")).alias("place"), name.alias("name"), F.lit("stad").alias("level"), "polygon", "k")
    return parish.unionByName(towns)


@query(f"""SELECT 'p' || k AS place, 'parish' AS level, k * 1000 + 500.0::DOUBLE AS x, 500.0::DOUBLE AS y, 1000000.0::DOUBLE AS area FROM {_N} WHERE r <> 2 AND k % 4 <> 3 UNION ALL SELECT 's' || k, 'stad', k * 1000 + 250.0, 250.0, 10000.0 FROM {_N} WHERE k % 5 = 0 AND r <> 2 AND k % 4 <> 3""")
def places_of_a_year(t):
    p = _parishes(t).join(_nations(t).select("k", "r"), "k")
    cross = p.select("place", "name", "level", F.when(F.col("r") == 2, "edge").otherwise("core").alias("role"), F.concat(F.lit("ref-"), "place").alias("ref_code"))
    old = p.select(F.concat(F.lit("ref-"), "place").alias("ref_code"), (F.col("k") * 10).alias("geom_id"), F.lit(0).alias("start"), F.when(F.col("k") % 4 == 3, 1880).otherwise(9999).alias("end"), "polygon")
    later = old.withColumns({"geom_id": F.col("geom_id") + 1, "start": F.lit(1950), "end": F.lit(9999)})
    out = places.places(cross, old.unionByName(later), 1890, ("parish", "stad"))
    return out.select("place", "level", "x", "y", G.area("polygon").alias("area"))


@query(f"""SELECT k AS geom_id, k % 2 = 0 AS start_is_unbounded, k % 3 = 0 AS end_is_open, k % 4 <> 0 AS has_join_keys, k % 4 <> 0 AND k % 5 = 0 AS ref_code_disagrees, CASE WHEN k > 0 THEN (k - 1)::VARCHAR ELSE '' END AS predecessors,
           CASE WHEN k % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, 1 + (k + 1) % 2 AS parts, round((1 + (k + 1) % 2) * 1.0, 6)::DOUBLE AS area_km2, true AS valid FROM {_N}""")
def boundary_units(t):
    n = _square("k", "k * 1000", "0", "1000", _nations(t)).withColumnRenamed("polygon_id", "geom_id")
    k = F.col("geom_id")
    units = n.select("geom_id", F.concat(F.lit("ref"), k.cast("string")).alias("ref_code"), F.lit("n").alias("name"), F.lit("Parish").alias("type"), F.lit("p").alias("type_id"), F.when(k % 2 == 0, 0).otherwise(1700).alias("start"), F.when(k % 3 == 0, 9999).otherwise(1950).alias("end"), F.when(k % 2 == 0, F.array("polygon", "polygon")).otherwise(F.array("polygon")).alias("polygons"))
    meta = units.where("geom_id % 4 <> 0").select("geom_id", F.when(k % 5 == 0, "other").otherwise(F.col("ref_code")).alias("ref_code"), F.lit("x").alias("name_x"), F.lit("y").alias("name_y"), F.lit(15).alias("county"))
    relations = units.where("geom_id > 0").select("geom_id", F.lit("pre").alias("kind"), (k - 1).alias("other_id"))
    out = places.boundary_units(units, meta, relations.unionByName(relations), ("p",))
    return out.select("geom_id", "start_is_unbounded", "end_is_open", "has_join_keys", "ref_code_disagrees", F.col("predecessor_geom_ids").alias("predecessors"), F.col("geometry_kind").alias("kind"), F.col("n_parts").cast("long").alias("parts"), "area_km2", F.col("geometry_valid").alias("valid"))


def _period(t):
    """A road from centre to centre of the parishes (k to k + 1 costs k + 1 minutes) and a railway nobody drives."""
    n = _nations(t)
    last = n.agg(F.max("k")).first()[0]
    nodes = n.select(F.col("k").alias("node"), (F.col("k") * 1000.0 + 500).alias("x"), F.lit(500.0).alias("y"))
    road = n.where(F.col("k") < last).select(F.col("k").alias("u"), (F.col("k") + 1).alias("v"), (F.col("k") + 1.0).alias("cost_min"), F.lit(1000.0).alias("length_m"), F.lit("road").alias("mode"))
    rail = t.spark.range(1).select(F.lit(0).cast("long").alias("u"), F.lit(last).cast("long").alias("v"), F.lit(0.1).alias("cost_min"), F.lit(1.0).alias("length_m"), F.lit("rail").alias("mode"))
    return road.unionByName(rail), nodes


def _surface(t):
    edges, nodes = _period(t)
    p = _parishes(t).withColumn("at", G.representative_point("polygon")).select("place", "name", "level", "polygon", "at.x", "at.y")
    people = _parishes(t).select("place", ((F.col("k") + 1) * 160.0).alias("population"))
    return places.surface_inputs(p, people, places.period_graph(edges, nodes)), p


_CELLS = f"""(SELECT 'c' || (k * 1000 + i * 250 + 125) || '_' || (j * 250 + 125) AS zone, 'cell' AS kind, k, k * 1000 + i * 250 + 125.0::DOUBLE AS x, j * 250 + 125.0::DOUBLE AS y, CASE WHEN k > 0 AND i = 0 AND j = 2 THEN 1000.0 ELSE 0 END::DOUBLE AS road_m,
    (k + 1) * 160.0::DOUBLE * (CASE WHEN k > 0 AND i = 0 AND j = 2 THEN 1050 ELSE 50 END) / (CASE WHEN k > 0 THEN 1800 ELSE 800 END) AS population FROM {_N}, range(4) a(i), range(4) b(j)
    UNION ALL SELECT 's' || k, 'town', k, k * 1000 + 250.0, 250.0, 0, (k + 1) * 160.0 FROM {_N} WHERE k % 5 = 0)"""
_ZONES = f"(SELECT *, sqrt((x - k * 1000 - 500) ** 2 + (y - 500) ** 2) AS leg, k * (k + 1) / 2.0::DOUBLE AS p FROM {_CELLS})"


@query(f"SELECT zone, kind, round(population, 6) AS population, road_m, round(leg, 6) AS connector_m, k AS node FROM {_ZONES}")
def population_surface(t):
    (_, zones), _ = _surface(t)
    return zones.select("zone", "kind", F.round("population", 6).alias("population"), "road_m", F.round("connector_m", 6).alias("connector_m"), "node")


@query(f"""WITH z AS {_ZONES} SELECT a.zone, round(sum(b.population * exp(-(a.leg * 0.012 + b.leg * 0.012 + abs(a.p - b.p)) / 30)), 4) AS accessibility FROM z a JOIN z b ON a.zone <> b.zone GROUP BY 1""")
def surface_accessibility(t):
    """The whole chain: places, cells, population by road, connectors, shortest paths, accessibility of every zone."""
    (edges, zones), _ = _surface(t)
    zones = cut(zones)
    out = network.accessibility(cut(edges), zones.select(F.col("zone_node").alias("zone"), "population"))
    return out.join(zones.select("zone_node", F.col("zone").alias("name")), F.col("zone_node") == F.col("zone")).select(F.col("name").alias("zone"), F.round("accessibility", 4).alias("accessibility"))


@query(f"""SELECT 'Place-' || k AS name, round(CASE WHEN k = 0 THEN sqrt(125 ** 2 * 2) * 0.012 + sqrt(250 ** 2 * 2) * 0.012 ELSE k * (k + 1) / 2.0::DOUBLE + sqrt(125 ** 2 * 2) * 0.012 + sqrt(250 ** 2 * 2) * 0.012 END, 6) AS past,
    round(CASE WHEN k = 0 THEN sqrt(125 ** 2 * 2) * 0.012 + sqrt(250 ** 2 * 2) * 0.012 ELSE k * (k + 1) / 2.0::DOUBLE + sqrt(125 ** 2 * 2) * 0.012 + sqrt(250 ** 2 * 2) * 0.012 END + 1, 6) AS today FROM {_N}""")
def travel_time_table(t):
    (edges, zones), p = _surface(t)
    times = cut(places.times_from(cut(edges), cut(zones), "s0", p))
    both = times.withColumn("period", F.lit("past")).unionByName(times.withColumns({"period": F.lit("today"), "minutes": F.col("minutes") + 1}))
    return places.travel_time_table(both, ["past", "today"]).select("name", F.round("past", 6).alias("past"), F.round("today", 6).alias("today"))


@query(f"""WITH z AS (SELECT k, 'q' || k AS place, k * (k + 1) / 2.0::DOUBLE AS p, (k + 1) * 10.0 AS pop FROM {_N}), a AS (SELECT a.place, sum(b.pop * exp(-(abs(a.p - b.p) + 2.4) / 30)) AS acc, count(*) AS n FROM z a JOIN z b ON a.k <> b.k GROUP BY 1)
    SELECT place, 100.0::DOUBLE AS connector_m, round(CASE WHEN k = 3 THEN 0 ELSE abs(p - 6) + 2.4 END, 6) AS minutes, n AS reachable, round(acc, 4) AS accessibility, round(acc / max(acc) OVER (), 6) AS share FROM z JOIN a USING (place)""")
def place_level_run(t):
    edges, nodes = _period(t)
    e = edges.where("mode = 'road'").select("u", "v", F.col("cost_min").alias("cost"))
    p = _nations(t).select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("place"), F.col("n_name").alias("name"), (F.col("k") * 1000.0 + 560).alias("x"), F.lit(580.0).alias("y"), ((F.col("k") + 1) * 10.0).alias("population"))
    out, _ = places.place_run(e, nodes, p.drop("population"), p.select("place", "population"), "q3", "past")
    return out.select("place", F.round("connector_m", 6).alias("connector_m"), F.round("minutes_to_target", 6).alias("minutes"), F.col("reachable_places").alias("reachable"), F.round("accessibility", 4).alias("accessibility"), F.round("accessibility_share_of_max", 6).alias("share"))


# ---- past networks


@query(f"""SELECT k AS u, k + 1 AS v, CASE WHEN k = 7 THEN 'gap bridged' WHEN k % 6 = 5 THEN 'modern, not checked' WHEN k % 4 = 1 THEN 'unscored' ELSE 'present' END AS status, 'road' AS mode FROM {_N} WHERE k < (SELECT max(k) FROM {_N})
           UNION ALL SELECT 9000, 9001, 'rail', 'rail' UNION ALL SELECT 9000, 0, 'rail', 'station_access' UNION ALL SELECT 9001, 3, 'rail', 'station_access'""")
def past_network(t):
    edges, nodes = _period(t)
    e = edges.where("mode = 'road'").select(F.col("u").alias("edge"), "u", "v", "cost_min", F.when(F.col("u") == 7, 150.0).otherwise(F.col("length_m")).alias("length_m"), "mode", (F.col("u") + 100).alias("way"))
    scored = e.where("u % 4 <> 1").select("way", F.when(F.col("u") == 7, "absent").otherwise("present").alias("present"), F.array(_p("u * 1000 + 900", "505"), _p("u * 1000 + 1100", "505")).alias("geom"))
    feet = _square("k", "k * 1000 + 700", "0", "800", _nations(t).where("k % 6 <> 5"))
    rail = t.spark.createDataFrame([("a", "b", 5.0)], "from_key string, to_key string, cost_min double")
    stations = t.spark.createDataFrame([("a", 9000, 0), ("a", 9100, 1), ("b", 9001, 3), ("c", 9002, 5)], "key string, station_node long, road_node long")
    out, _ = matched.past_network(e, nodes, scored, feet, rail, stations)
    return out.select("u", "v", "status", "mode")


# ---- the country


@query(f"SELECT (k + i) * 100000 + j AS cell FROM {_N}, range(2) a(i), range(3) b(j) GROUP BY 1")
def coverage_cells(t):
    s = _nations(t).select(*(F.expr(x).cast("double").alias(c) for c, x in (("xmin", "k * 1000 + 500"), ("ymin", "500"), ("xmax", "k * 1000 + 1500"), ("ymax", "2999"))), F.lit("ok").alias("status"))
    bad = s.withColumns({"status": F.lit("error: x"), "ymax": F.lit(99999.0)})
    return national.coverage_cells(s.unionByName(bad))


@query(f"SELECT k AS polygon_id, k * 3 + i AS ix, j AS iy FROM {_N}, range(2) a(i), range(2) b(j) WHERE k < 20")
def cells_of_areas(t):
    core = _square("k", "0", "0", "59500", _nations(t).where("k = 0"))
    return national.cells_of_areas(_square("k", "k * 3000", "0", "2000", _nations(t)), within=core)


@query(f"SELECT DISTINCT k * 4 + i AS ix, 0::BIGINT AS iy FROM {_N}, range(3) r(i) UNION SELECT k * 4, 7 FROM {_N} WHERE k % 5 = 0")
def start_cells(t):
    lines = _nations(t).select(_line(("k * 4000 + 500", "500"), ("k * 4000 + 2500", "500")).alias("geom"))
    towns = _nations(t).where("k % 5 = 0").select((F.col("k") * 4000.0 + 1).alias("x"), F.lit(7500.0).alias("y"))
    return national.start_cells(lines, towns)


def _country(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row of cells per nation: a base road in the first two, a main road along the first ``k % 5 + 3``."""
    c = _nations(t).select("k", "r", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    cells = c.select((F.col("i") * search.PACK + F.col("k") * 50).cast("long").alias("cell"), F.when(F.col("i") < 9, F.concat(F.lit("p"), F.col("k").cast("string"), F.when(F.col("i") < 5, "a").otherwise("b"))).alias("parish"), F.col("r").alias("county"))
    v = c.withColumns({"x": F.col("i") * 1000.0 + 500, "y": F.col("k") * 50000.0 + 500})
    base = v.where("i < 2").select((F.col("k") * 2).alias("line"), F.col("i").alias("ord"), "x", "y", F.lit(0).alias("grp"))
    main = v.where("i < k % 5 + 3").select((F.col("k") * 2 + 1).alias("line"), F.col("i").alias("ord"), "x", "y", F.lit(1).alias("grp"))
    towns = t.spark.range(1).select(F.lit(9 * search.PACK).cast("long").alias("cell"))
    return cells, base.unionByName(main), towns


_ROWS = f"""(SELECT i * 100000 + k * 50 AS cell, k, r, i, CASE WHEN i < 9 THEN 'p' || k || CASE WHEN i < 5 THEN 'a' ELSE 'b' END END AS parish, k % 5 + 2 AS last,
    CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN 2000 WHEN i <= k % 5 + 2 THEN 1000 ELSE 0 END::DOUBLE AS road FROM {_N}, range(10) a(i))"""
_GOALS = f"(SELECT k, max(i) AS deep FROM (SELECT k, parish, arg_min(i, (-road, cell)) AS i FROM {_ROWS} WHERE parish IS NOT NULL AND i <= last GROUP BY 1, 2) GROUP BY 1)"


@query(f"SELECT cell, parish IS NOT NULL AS land, road AS road_m, i <= greatest(deep, 0) AND i >= least(deep, 1) AS lb, i <= greatest(deep, 1) AS read, i < 2 AS start FROM {_ROWS} JOIN {_GOALS} USING (k)")
def national_estimate(t):
    cells, vertices, towns = _country(t)
    out = national.estimate(cells, vertices, towns, {"all": (0, 1)})
    return out.select("cell", "land", F.col("road_m_all").alias("road_m"), F.col("lb_all").alias("lb"), F.col("read_all").alias("read"), F.col("start_all").alias("start"))


@query("""SELECT CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE c_nationkey END AS county, c_mktsegment AS county_name, count(*) AS land_tiles, count(*) FILTER (c_acctbal > 0) AS any_road_x, count(*) FILTER (c_custkey % 3 = 0) AS search_x, count(*) FILTER (c_custkey % 6 = 0) AS lb_x
          FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1, 2""")
def county_table(t):
    c = t.customer.select(F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey")).alias("county"), F.col("c_mktsegment").alias("county_name"), (F.col("c_custkey") % 10 != 0).alias("land"), F.col("c_acctbal").alias("road_m_x"), (F.col("c_custkey") % 3 == 0).alias("read_x"), (F.col("c_custkey") % 6 == 0).alias("lb_x"))
    return national.county_table(c, ("x",))


@query("SELECT c_nationkey, count(*) AS n, round(count(*) * 110444 / 1e9, 9) AS reading_bn, round(count(*) * 53319 / 1e9, 9) AS review_bn, round(count(*) * 9.8 / 60, 6) AS model_hours FROM customer GROUP BY 1")
def cost_table(t):
    c = national.cost_table(t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n")))
    return c.select("c_nationkey", "n", F.round("reading_bn", 9).alias("reading_bn"), F.round("review_bn", 9).alias("review_bn"), F.round("model_hours", 6).alias("model_hours"))


@query("SELECT ix, iy, (row_number() OVER (ORDER BY ix, iy) - 1) // 24 AS batch FROM (SELECT DISTINCT c_custkey % 40 AS ix, c_custkey // 40 AS iy FROM customer WHERE c_acctbal >= 0)")
def fill_batches(t):
    cell = (F.col("c_custkey") % 40).alias("ix"), F.floor(F.col("c_custkey") / 40).alias("iy")
    return national.fill_batches(t.customer.select(*cell), t.customer.where("c_acctbal < 0").select(*cell))


@query("""SELECT o_orderpriority AS kind, count(*) AS runs, round(sum(o_totalprice) / 3600, 1) AS hours, round(median(o_totalprice) / 60, 1) AS median_min, sum(o_orderkey)::BIGINT AS tokens, count(*) FILTER (o_custkey % 3 > 1) AS retries, count(*) FILTER (o_orderstatus = 'F') AS passed FROM orders GROUP BY 1""")
def run_accounting(t):
    r = t.orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("wall_s"), F.col("o_orderkey").alias("tokens"), (F.col("o_custkey") % 3).alias("attempt"), (F.col("o_orderstatus") == "F").alias("ok"))
    return national.accounting(r)


@query("""SELECT c_custkey AS run, c_custkey % 4 <> 1 AND c_custkey % 5 <> 2 AS tools_ok, c_custkey % 4 <> 1 AND c_custkey % 5 <> 2 AND c_custkey % 6 <> 3 AS ok, 2::BIGINT AS reads, 60 + c_custkey AS tokens FROM customer""")
def event_stream_audit(t):
    c = F.col("c_custkey")
    model = F.when(c % 6 == 3, "other").otherwise("wanted")
    use = lambda name, file: F.concat(F.lit('{"message":{"model":"'), model, F.lit('","content":[{"type":"text","text":"x"},{"type":"tool_use","name":"' + name + '","input":{"file_path":"'), file, F.lit('"}}]}}'))
    second = F.when(c % 4 == 1, "/elsewhere.png").otherwise("/b.png")
    end = F.concat(F.lit('{"type":"result","usage":{"input_tokens":10,"cache_read_input_tokens":20,"output_tokens":'), (c + 30).cast("string"), F.lit('},"total_cost_usd":0.5,"modelUsage":{"wanted":{}}}'))
    lines = F.array(F.lit("not json {"), use("Read", F.lit("/a.png")), use("Read", second), F.when(c % 5 == 2, use("Bash", F.lit("ls"))).otherwise(F.lit('{"type":"system"}')), use("Write", F.lit("/out.json")), end)
    events = t.customer.select(c.alias("run"), F.explode(lines).alias("line"))
    allowed = t.customer.select(c.alias("run"), F.explode(F.array(*(F.struct(F.lit(f).alias("file"), F.lit(k).alias("kind")) for f, k in (("/a.png", "read"), ("/b.png", "read"), ("/out.json", "write"))))).alias("a")).select("run", "a.*")
    return national.audit(events, allowed, "wanted").select("run", "tools_ok", "ok", "reads", "tokens")


def _tile_answers(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = cut(_reviewed(t))
    x = F.col("k") % 5 * 1000.0
    y = (F.floor(F.col("k") / 5) * 1000.0).cast("double")
    tiles = rows.select("tile_id", F.lit(1000.0).alias("display_w"), F.lit(1000.0).alias("display_h"), x.alias("xmin"), y.alias("ymin"), (x + 1000).alias("xmax"), (y + 1000).alias("ymax"))
    state = rows.select("tile_id", F.when(F.col("k") % 4 == 3, "failed").otherwise("ok").alias("status"), (F.col("k") % 3).alias("round"))
    return rows.drop("k"), tiles, state


@query(f"SELECT tile_id, status, round, CASE WHEN status = 'ok' AND c_nationkey % 6 <> 5 THEN n ELSE 0 END AS lines FROM (SELECT c_nationkey, 't' || c_nationkey AS tile_id, CASE WHEN c_nationkey % 4 = 3 THEN 'failed' ELSE 'ok' END AS status, c_nationkey % 3 AS round, count(*) FILTER (c_custkey % 7 IN (0, 1, 2, 6)) AS n FROM customer GROUP BY 1)")
def assembled_tiles(t):
    rows, tiles, state = _tile_answers(t)
    return national.assemble(rows, tiles, state, "reader", "reviewer", {k: "x" for k in A.PROVENANCE_FIELDS})["tiles"].select("tile_id", "status", "round", "lines")


# ---- repairs


def _ladder(t) -> DataFrame:
    """One long road and, per nation, a short one beside it at ``k * 20 + 60`` metres: some too short, some too far."""
    n = _nations(t)
    last = n.agg(F.max("k")).first()[0]
    main = t.spark.range(1).select(F.lit(-1).cast("long").alias("line_id"), F.array(_p("-500", "0"), _p(f"{last} * 2000 + 2000", "0")).alias("geom"))
    return main.unionByName(n.select(F.col("k").alias("line_id"), _line(("k * 2000", "k * 20 + 60"), ("k * 2000 + if(k % 5 = 0, 90, 300)", "k * 20 + 60")).alias("geom")))


@query(f"SELECT printf('R%03d', row_number() OVER (ORDER BY k)) AS case_id, k * 20 + 60.0::DOUBLE AS gap_m, 300.0::DOUBLE AS component_m, 2 AS a, 2 AS b FROM {_N} WHERE k % 5 <> 0 AND k * 20 + 60 <= 400")
def component_cases(t):
    pieces, nodes = repair.labelled_pieces(_ladder(t))
    c = repair.component_cases(pieces, nodes)
    return c.select("case_id", "gap_m", "component_m", F.size("a_points").alias("a"), F.size("b_points").alias("b"))


@query(f"SELECT k * 20 + 60.0::DOUBLE AS gap_m, k * 20 + 60.0::DOUBLE AS length_m FROM {_N} WHERE k % 5 <> 0 AND k * 20 + 60 <= 400 AND k % 2 = 0")
def repairs_until_nothing_connects(t):
    def answer(cases):
        even = F.round((F.col("gap_m") - 60) / 20) % 2 == 0
        return cases.select("case_id", F.when(even, "connect").otherwise("leave").alias("decision"), F.lit("A1").alias("from"), F.lit("B1").alias("to"), F.lit(None).cast("array<array<double>>").alias("waypoints_uv"), F.lit("seen").alias("reason"))

    done, _ = repair.repair_passes(_ladder(t), answer, "label")
    return done.select("gap_m", F.round(G.length("geom"), 6).alias("length_m"))


@query(f"SELECT k * 10 + 100.0::DOUBLE AS gap_m, 1 AS targets FROM {_N} WHERE k % 2 = 1 AND k * 10 + 100 <= 400")
def cut_cases(t):
    """Per nation a spur that ends near the road it left, near by (even) or far along it (odd)."""
    n = _nations(t)
    last = n.agg(F.max("k")).first()[0]
    road = t.spark.range(1).select(F.lit(-1).cast("long").alias("line_id"), F.array(_p("0", "0"), _p(f"({last} + 1) * 20000", "0")).alias("geom"))
    back = "k * 20000 + if(k % 2 = 1, 5000, 300)"
    spur = n.select(F.col("k").alias("line_id"), _line(("k * 20000 + 1000", "0"), ("k * 20000 + 1000", "3000"), (f"{back} + 1000", "3000"), (f"{back} + 1000", "k * 10 + 100")).alias("geom"))
    short = n.where("k % 2 = 0").select(F.col("k").alias("line_id"), _line(("k * 20000 + 1000", "0"), ("k * 20000 + 1000", "k * 10 + 400")).alias("geom"))
    pieces, nodes = repair.labelled_pieces(road.unionByName(spur.where("line_id % 2 = 1")).unionByName(short))
    ends = nodes.where("y > 0 or degree <> 1")  # the road's own ends are no cases
    return repair.cut_cases(pieces, ends).select("gap_m", F.size("b_points").alias("targets"))


@query(f"SELECT ix, iy FROM (SELECT k * 2 AS ix, i AS iy FROM {_N}, range(3) a(i) WHERE k = 0) UNION SELECT k, 0 FROM {_N} WHERE k BETWEEN 1 AND 3")
def cells_of_the_connected_network(t):
    road = t.spark.range(1).select(F.lit(-1).cast("long").alias("line_id"), _line(("500", "500"), ("3900", "500")).alias("geom"))
    up = t.spark.range(1).select(F.lit(-2).cast("long").alias("line_id"), _line(("600", "500"), ("600", "2500")).alias("geom"))
    off = _nations(t).select(F.col("k").alias("line_id"), _line(("k * 100", "9000 + k * 100"), ("k * 100 + 50", "9000 + k * 100")).alias("geom"))
    net = national.connected_network(road.unionByName(up).unionByName(off))
    return net["cells"]


@query(f"SELECT k + 1 AS ix, 0::BIGINT AS iy FROM {_N} WHERE k % 3 = 0 AND k + 1 NOT IN (SELECT k FROM {_N} WHERE k % 2 = 0) AND k IN (SELECT k FROM {_N} WHERE k % 2 = 0)")
def strict_frontier(t):
    ends = _nations(t).where("k % 3 = 0").select((F.col("k") * 1000.0 + 985).alias("x"), F.lit(500.0).alias("y"))
    attempted = _nations(t).where("k % 2 = 0").select(F.col("k").alias("ix"), F.lit(0).cast("long").alias("iy"))
    return national.strict_frontier(ends, attempted)


@query(f"SELECT 'q' || k AS place, k IN (1, 3, 4) AS mended FROM {_N} WHERE k < 5")
def demo_run(t):
    """Two roads with a gap: the repair connects them, and every place on them is reached."""
    lines = t.spark.createDataFrame([(0, [(0.0, 0.0), (2000.0, 0.0)]), (1, [(2300.0, 0.0), (4500.0, 0.0)])], f"line_id long, geom {G.LINE}")
    spots = _nations(t).where("k < 5").select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("place"), F.col("n_name").alias("name"), (F.col("k") * 1000.0).alias("x"), F.lit(0.0).alias("y"))
    connect = lambda c: c.select("case_id", F.lit("connect").alias("decision"), F.lit("A1").alias("from"), F.lit("B1").alias("to"), F.lit(None).cast("array<array<double>>").alias("waypoints_uv"), F.lit("gap").alias("reason"))
    out = national.demo(lines, spots, spots.select("place", F.lit(1.0).alias("population")), "q0", connect)
    far = F.col("connector_m") > 400
    return out["places"].select("place", (far & (F.col("reachable_places") == 4)).alias("mended"))
