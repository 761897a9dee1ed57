"""Registered queries of the network, surface and annotation operators, each over whole driver tables, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netspark.functions import answers as A
from netspark.functions import geometry as G
from netspark.operators import network, paths, search, spatial, surface
from netspark.operators.components import connected_components
from netspark.plans.iterate import cut
from netspark.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULE: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        MODULE[f.__name__] = f.__module__
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


# ---- scans, projections, predicates


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 GROUP BY 1")
def scan_pruned_and_pushed(t):
    rows = t.lineitem.select("l_returnflag", "l_extendedprice", "l_discount").where("l_discount between 0.05 and 0.07")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT event_id FROM events WHERE value - 5 <= 40 AND value + 5 >= 20 AND event_id % 100 <= 70 AND event_id % 100 + 10 >= 30")
def scan_bounding_box(t):
    """Boxes about events, stored and read again through a pushed box."""
    from netspark.more_queries import _folder

    d, v, y = _folder(t.spark, "boxes"), F.col("value"), (F.col("event_id") % 100).cast("double")
    boxes = t.events.select("event_id", (v - 5).alias("xmin"), y.alias("ymin"), (v + 5).alias("xmax"), (y + 10).alias("ymax"))
    writers.layer(boxes, d, "boxes")
    return readers.parquet(t.spark, f"{d}/boxes", ["event_id"], (20.0, 30.0, 40.0, 70.0))


@query("SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages")
def links_of_pages(t):
    return readers.links(t.pages.select("page_id", "html"))


@query("""
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'rich'
           WHEN c_acctbal >= 5000 THEN 'good' ELSE 'plain' END AS kind,
           concat_ws(':', c_custkey, c_nationkey, lower(c_mktsegment)) AS key FROM customer""")
def case_and_composite_key(t):
    kind = F.when(F.col("c_acctbal") < 0, "debt").when((F.col("c_acctbal") >= 5000) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "rich").when(F.col("c_acctbal") >= 5000, "good").otherwise("plain")
    return t.customer.select("c_custkey", kind.alias("kind"), F.concat_ws(":", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.lower("c_mktsegment")).alias("key"))


@query("""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) THEN 'not_measurable' WHEN value >= 50 THEN 'pass' ELSE 'fail' END AS verdict,
          coalesce(TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT), 0) AS k FROM events""")
def threshold_verdict(t):
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(0))
    return t.events.select("event_id", A.verdict(F.col("value"), F.lit(50.0)).alias("verdict"), k.cast("long").alias("k"))


@query("""SELECT event_id, CASE WHEN lower(event_type) IN ('click', 'view', 'purchase') THEN lower(event_type) ELSE 'unknown' END AS word,
          upper(event_type) AS raw, regexp_matches(lower(event_type), '^(click|view)$') AS seen, format('e{:06d}', event_id) AS name FROM events""")
def closed_vocabulary(t):
    low = F.lower("event_type")
    return t.events.select("event_id", F.when(low.isin("click", "view", "purchase"), low).otherwise("unknown").alias("word"), F.upper("event_type").alias("raw"), low.rlike("^(click|view)$").alias("seen"), F.format_string("e%06d", "event_id").alias("name"))


@query("SELECT doc_id, sha256(text) AS sha, substr(text, 1, 300) AS head, length(text) AS n FROM documents")
def text_hash_and_truncate(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.substring("text", 1, 300).alias("head"), F.length("text").cast("long").alias("n"))


# ---- joins


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def inner_join(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_join_with_default(t):
    n = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t.customer.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(t):
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def semi_join(t):
    return t.part.join(t.lineitem.where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey")


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS last_id, arg_min(event_id, event_id) AS first_id, count(*) AS n FROM events GROUP BY 1, 2""")
def first_and_last_wins(t):
    e = t.events.select("user_id", "event_type", "event_id")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", "event_id").alias("last_id"), F.min_by("event_id", "event_id").alias("first_id"), F.count("*").alias("n"))


@query("""WITH v(label, a, b) AS (VALUES ('early', 1992, 1994), ('middle', 1994, 1996), ('late', 1996, 9999))
          SELECT o_orderkey, label FROM orders JOIN v ON year(o_orderdate) BETWEEN a AND b""")
def valid_at_time_join(t):
    v = t.spark.createDataFrame([("early", 1992, 1994), ("middle", 1994, 1996), ("late", 1996, 9999)], "label string, a int, b int")
    o = t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))
    return o.join(F.broadcast(v), F.col("y").between(F.col("a"), F.col("b"))).select("o_orderkey", "label")


_POINTS = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings"


def _points(t, label: str = "label") -> DataFrame:
    e = t.embeddings
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), label)


@query(f"WITH p AS ({_POINTS}) SELECT a.id AS a_id, b.id AS b_id, round(sqrt((a.x-b.x)**2+(a.y-b.y)**2), 6) AS dist FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1 WHERE sqrt((a.x-b.x)**2+(a.y-b.y)**2) <= 0.02")
def within_distance_join(t):
    p = _points(t)
    return spatial.within_distance(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.02).withColumn("dist", F.round("dist", 6))


@query(f"""WITH p AS ({_POINTS}), d AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1)
           SELECT a_id, b_id, round(d, 6) AS dist FROM d WHERE d <= 0.05 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) = 1""")
def nearest_join(t):
    p = _points(t)
    return spatial.nearest(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.05).withColumn("dist", F.round("dist", 6))


@query(f"""WITH p AS ({_POINTS}), d AS (SELECT a.id AS a_id, b.id AS b_id, sqrt((a.x-b.x)**2+(a.y-b.y)**2) AS d FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1),
           r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY d, a_id) AS rb FROM d WHERE d <= 0.05)
           SELECT a_id, b_id, round(d, 6) AS dist FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nearest_join(t):
    p = _points(t)
    return spatial.mutual_nearest(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.05).withColumn("dist", F.round("dist", 6))


_SQUARES = "SELECT n_nationkey AS k, (n_nationkey % 5 - 2.5) * 0.1 AS x1, (n_nationkey // 5 - 2.5) * 0.1 AS y1 FROM nation"


def _squares(t) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") % 5 - 2.5) * 0.1).alias("x1"), ((F.floor(F.col("n_nationkey") / 5) - 2.5) * 0.1).alias("y1"))
    p = lambda dx, dy: F.struct((F.col("x1") + dx).alias("x"), (F.col("y1") + dy).alias("y"))
    ring = F.array(p(0.0, 0.0), p(0.07, 0.0), p(0.07, 0.07), p(0.0, 0.07), p(0.0, 0.0))
    return n.select(F.col("k").cast("long").alias("polygon_id"), F.array(ring).alias("polygon"))


@query(f"WITH p AS ({_POINTS}), s AS ({_SQUARES}) SELECT id, k::BIGINT AS polygon_id FROM p JOIN s ON x >= x1 AND x < x1 + 0.07 AND y >= y1 AND y < y1 + 0.07")
def point_in_polygon_join(t):
    return spatial.points_in_polygons(_points(t), _squares(t), 0.1)


@query(f"""WITH b AS (SELECT id, x AS xmin, y AS ymin, x + 0.01 AS xmax, y + 0.02 AS ymax FROM ({_POINTS}))
           SELECT a.id AS a_id, c.id AS b_id FROM b a JOIN b c ON a.xmin <= c.xmax AND c.xmin <= a.xmax AND a.ymin <= c.ymax AND c.ymin <= a.ymax AND a.id < c.id""")
def boxes_meet_join(t):
    b = _points(t).select("id", F.col("x").alias("xmin"), F.col("y").alias("ymin"), (F.col("x") + 0.01).alias("xmax"), (F.col("y") + 0.02).alias("ymax"))
    return spatial.boxes_meet(b, b, 0.05).where("a_id < b_id")


# ---- aggregations, windows, sets


@query("SELECT n_nationkey, count(c_custkey) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS total, count(*) FILTER (c_acctbal < 0) AS debts, max(c_mktsegment) AS segment FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def grouped_sums(t):
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_nationkey").agg(F.count("c_custkey").alias("n"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("total"), F.count_if(F.col("c_acctbal") < 0).alias("debts"), F.max("c_mktsegment").alias("segment"))


@query("SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS poorest, arg_max(s_suppkey, (s_acctbal, s_suppkey)) AS richest FROM supplier GROUP BY 1")
def arg_min_and_max(t):
    key = F.struct("s_acctbal", "s_suppkey")
    return t.supplier.groupBy("s_nationkey").agg(F.min_by("s_suppkey", key).alias("poorest"), F.max_by("s_suppkey", key).alias("richest"))


@query("SELECT l_shipdate::DATE AS day, round(median(l_extendedprice), 4) AS mid, round(quantile_cont(l_extendedprice, 0.99), 4) AS high FROM lineitem GROUP BY 1")
def exact_quantiles(t):
    price = F.col("l_extendedprice")
    return t.lineitem.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.median(price), 4).alias("mid"), F.round(F.percentile(price, F.lit(0.99)), 4).alias("high"))


_PIVOT = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus AS origin, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{p}'), 4) AS p{p[0]}" for p in _PIVOT) + " FROM orders GROUP BY 1")
def pivot_means(t):
    m = t.orders.groupBy(F.col("o_orderstatus").alias("origin"), F.col("o_orderpriority").alias("destination")).agg(F.round(F.avg("o_totalprice"), 4).alias("minutes"))
    return writers.wide_matrix(m, _PIVOT).toDF("origin", *(f"p{p[0]}" for p in _PIVOT))


@query("""WITH w AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) = 1993) AS y1993, count(*) FILTER (year(o_orderdate) = 1994) AS y1994, count(*) FILTER (year(o_orderdate) = 1995) AS y1995 FROM orders GROUP BY 1)
          SELECT o_custkey, 1993 AS year, y1993::DOUBLE AS value FROM w UNION ALL SELECT o_custkey, 1994, y1994 FROM w UNION ALL SELECT o_custkey, 1995, y1995 FROM w""")
def unpivot_years(t):
    y = F.year("o_orderdate")
    wide = t.orders.groupBy("o_custkey").agg(*(F.count_if(y == k).alias(f"y{k}") for k in (1993, 1994, 1995)))
    return surface.long_series(wide, ["o_custkey"])


@query("SELECT l_suppkey, string_agg(k::VARCHAR, ';' ORDER BY k) AS ids FROM (SELECT DISTINCT l_suppkey, l_partkey AS k FROM lineitem) GROUP BY 1")
def collected_set_text(t):
    return surface.joined_ids(t.lineitem, "l_suppkey", "l_partkey")


@query("""SELECT c_custkey AS cell, round(total * w / sum(w) OVER (PARTITION BY c_nationkey), 4) AS population
          FROM (SELECT *, greatest(c_acctbal, 0) + 50 AS w FROM customer) JOIN (SELECT s_nationkey, sum(s_acctbal) AS total FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey""")
def disaggregate_totals(t):
    cells = t.customer.select(F.col("c_custkey").alias("cell"), F.col("c_nationkey").alias("place"), F.greatest("c_acctbal", F.lit(0.0)).alias("road_m"))
    totals = t.supplier.groupBy(F.col("s_nationkey").alias("place")).agg(F.sum("s_acctbal").alias("population"))
    out = surface.disaggregate(cells.join(totals.select("place"), "place", "left_semi"), totals)
    return out.select("cell", F.round("population", 4).alias("population"))


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, sum(l_extendedprice) AS v FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
          SELECT s_suppkey AS zone, round(v / max(v) OVER (PARTITION BY s_nationkey), 6) AS share,
                 round(least(v / quantile_cont(v, 0.99) OVER (PARTITION BY s_nationkey), 1), 6) AS score FROM s""")
def share_and_relative_score(t):
    v = t.supplier.join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", F.col("s_suppkey").alias("zone")).agg(F.sum("l_extendedprice").alias("accessibility"))
    v = network.relative_score(v, by=["s_nationkey"])
    share = F.col("accessibility") / F.max("accessibility").over(Window.partitionBy("s_nationkey"))
    return v.select("zone", F.round(share, 6).alias("share"), F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT *, lag(value) OVER w AS pv, lag(event_type) OVER w AS pt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
          SELECT event_id, round(coalesce(value - pv, 0), 4) AS step, coalesce(pt <> event_type, false) AS changes FROM e""")
def lag_and_transitions(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))
    return t.events.select("event_id", F.round(step, 4).alias("step"), F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(False)).alias("changes"))


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1) AS repeated FROM events")
def duplicate_marks(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("event_id", (F.row_number().over(w) > 1).alias("repeated"))


@query("SELECT n_nationkey, n_name FROM (SELECT *, abs(n_nationkey - 12) AS d FROM nation) ORDER BY d DESC, n_nationkey LIMIT 7")
def top_k_with_ties(t):
    return t.nation.orderBy(F.abs(F.col("n_nationkey") - 12).desc(), "n_nationkey").limit(7).select("n_nationkey", "n_name")


@query("""SELECT c_nationkey AS k, 'both' AS kind FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
          UNION ALL SELECT n_nationkey, 'customers only' FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def set_operations(t):
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("kind", F.lit("both")).unionByName(c.subtract(s).withColumn("kind", F.lit("customers only")))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 100 AS batch FROM orders")
def fixed_batches(t):
    return search.batches(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "batch")


@query("SELECT l_partkey AS u, l_suppkey AS v, min(l_extendedprice / l_quantity) AS cost, count(*) AS n FROM lineitem GROUP BY 1, 2")
def cheapest_per_pair(t):
    cost = F.col("l_extendedprice") / F.col("l_quantity")
    return t.lineitem.groupBy(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.min(cost).alias("cost"), F.count("*").alias("n"))


# ---- grid and geometry


@query(f"""WITH p AS ({_POINTS}) SELECT floor(x / 0.05)::BIGINT AS cx, floor(y / 0.05)::BIGINT AS cy, count(*) AS n FROM p GROUP BY 1, 2""")
def grid_bins(t):
    return _points(t).groupBy(spatial.cell("x", 0.05).alias("cx"), spatial.cell("y", 0.05).alias("cy")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT r_regionkey * 1000.0 AS x, r_regionkey * 500.0 AS y FROM region)
          SELECT DISTINCT cx, cy, (cx + 0.5::DOUBLE) * 250 AS x, (cy + 0.5::DOUBLE) * 250 AS y FROM (SELECT unnest(range(floor(x / 250)::BIGINT, ceil((x + 1100) / 250)::BIGINT)) AS cx, y FROM b) c, LATERAL (SELECT unnest(range(floor(c.y / 250)::BIGINT, ceil((c.y + 900) / 250)::BIGINT)) AS cy)""")
def grid_generator(t):
    b = t.region.select((F.col("r_regionkey") * 1000.0).alias("xmin"), (F.col("r_regionkey") * 500.0).alias("ymin"))
    return surface.grid_cells(b.withColumns({"xmax": F.col("xmin") + 1100, "ymax": F.col("ymin") + 900}))


_STEPS = "SELECT user_id, value AS x2, (event_id % 97)::DOUBLE AS y2, lag(value) OVER w AS x1, lag((event_id % 97)::DOUBLE) OVER w AS y1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _lines(t) -> DataFrame:
    p = F.struct("ts", "event_id", F.struct(F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y")).alias("p"))
    e = t.events.where("value is not null").groupBy(F.col("user_id").alias("line_id")).agg(F.sort_array(F.collect_list(p)).alias("v"))
    return e.select("line_id", F.transform("v", lambda x: x["p"]).alias("geom"))


@query(f"SELECT user_id AS line_id, round(coalesce(sum(sqrt((x2-x1)**2+(y2-y1)**2)), 0), 3) AS length_m FROM ({_STEPS}) GROUP BY 1")
def line_length(t):
    return _lines(t).select("line_id", F.round(G.length("geom"), 3).alias("length_m"))


@query(f"SELECT floor((x1+x2)/2/10)::BIGINT AS cx, floor((y1+y2)/2/10)::BIGINT AS cy, round(sum(sqrt((x2-x1)**2+(y2-y1)**2)), 3) AS road_m FROM ({_STEPS}) WHERE x1 IS NOT NULL GROUP BY 1, 2")
def road_length_per_cell(t):
    return surface.road_length(G.segments(_lines(t), "line_id"), 10.0).withColumn("road_m", F.round("road_m", 3))


@query(f"""WITH c AS (SELECT user_id, floor(x1/10)::BIGINT*100000+floor(y1/10)::BIGINT AS a, floor(x2/10)::BIGINT*100000+floor(y2/10)::BIGINT AS b FROM ({_STEPS}) WHERE x1 IS NOT NULL)
           SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM c WHERE a <> b""")
def tile_graph_links(t):
    v = _lines(t).select(F.col("line_id").alias("line"), F.posexplode("geom").alias("ord", "p")).select("line", "ord", "p.x", "p.y", F.lit(0).alias("grp"))
    return search.tile_graph(v, 10.0)[1]


# ---- graphs


_ROADS = """SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, min(l_extendedprice) / 100 AS cost
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
            WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"""
_WAYS = f"""WITH RECURSIVE g AS ({_ROADS}), b AS (SELECT u AS a, v AS b, cost FROM g UNION ALL SELECT v, u, cost FROM g),
    sp(o, d, t) USING KEY (o, d) AS (SELECT DISTINCT a, a, 0.0::DOUBLE FROM b UNION
      SELECT x.o, x.d, x.t FROM (SELECT sp.o, b.b AS d, min(sp.t + b.cost) AS t FROM sp JOIN b ON b.a = sp.d GROUP BY 1, 2) x
      LEFT JOIN recurring.sp r ON r.o = x.o AND r.d = x.d WHERE r.t IS NULL OR x.t < r.t)"""


def _roads(t) -> DataFrame:
    """Nations, linked by the cheapest line between a customer of one and a supplier of the other."""
    j = t.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    j = j.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    pair = [F.least("c_nationkey", "s_nationkey").cast("long").alias("u"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("v")]
    return j.where("c_nationkey <> s_nationkey").groupBy(*pair).agg((F.min("l_extendedprice") / 100).alias("cost"))


def _zones(t) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("zone")).agg(F.count("*").cast("double").alias("population"))


@query(f"{_WAYS} SELECT o::BIGINT AS origin, d::BIGINT AS node, round(t, 6) AS dist FROM sp")
def shortest_paths(t):
    roads = _roads(t)
    origins = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("node"))
    return paths.shortest_paths(roads, origins).select("origin", "node", F.round("dist", 6).alias("dist"))


@query(f"""{_WAYS}, p AS (SELECT c_nationkey AS z, count(*)::DOUBLE AS pop FROM customer GROUP BY 1),
           acc AS (SELECT o AS zone, sum(pop * exp(-t / 30)) AS a FROM sp JOIN p ON p.z = d WHERE o <> d GROUP BY 1)
           SELECT zone::BIGINT AS zone, round(a, 4) AS accessibility, round(a / max(a) OVER (), 6) AS share FROM acc""")
def accessibility(t):
    a = cut(network.accessibility(_roads(t), _zones(t)))  # read twice
    top = F.broadcast(a.agg(F.max("accessibility").alias("top")))  # one row
    return a.crossJoin(top).select("zone", F.round("accessibility", 4).alias("accessibility"), F.round(F.col("accessibility") / F.col("top"), 6).alias("share"))


@query(f"""WITH RECURSIVE g AS ({_ROADS}), b AS (SELECT u AS a, v AS b, cost FROM g WHERE cost < 12 UNION ALL SELECT v, u, cost FROM g WHERE cost < 12),
    s(n, d) USING KEY (n) AS (SELECT DISTINCT a, 0.0::DOUBLE FROM b WHERE a IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) UNION
      SELECT x.n, x.d FROM (SELECT b.b AS n, min(s.d + b.cost) AS d FROM s JOIN b ON b.a = s.n GROUP BY 1) x LEFT JOIN recurring.s r ON r.n = x.n WHERE r.d IS NULL OR x.d < r.d)
    SELECT n::BIGINT AS node, round(d, 6) AS dist FROM s""")
def nearest_source(t):
    roads = _roads(t).where("cost < 12")
    sources = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").cast("long").alias("node"))
    known = paths.symmetric(roads.select("u", "v")).select(F.col("u").alias("node"))
    return paths.nearest_source(roads, sources.join(known, "node", "left_semi")).select("node", F.round("dist", 6).alias("dist"))


_TRADE = "SELECT DISTINCT o_custkey AS u, 10000000 + o_orderkey AS v FROM orders"


@query(f"""WITH RECURSIVE e AS ({_TRADE}), b AS (SELECT u AS a, v AS b FROM e UNION SELECT v, u FROM e), n AS (SELECT DISTINCT a FROM b),
    cc(id, lab) USING KEY (id) AS (SELECT a, a FROM n UNION SELECT x.id, x.lab FROM (SELECT b.b AS id, min(cc.lab) AS lab FROM cc JOIN b ON b.a = cc.id GROUP BY 1) x
      JOIN recurring.cc r ON r.id = x.id WHERE x.lab < r.lab) SELECT id AS node, lab AS component FROM cc""")
def components(t):
    return connected_components(t.orders.select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") + 10000000).alias("v")))


@query(f"""WITH e AS ({_TRADE}), d AS (SELECT u AS node, count(*) AS degree FROM (SELECT u FROM e UNION ALL SELECT v FROM e) GROUP BY 1)
           SELECT u AS component, 1 + n AS nodes, degree FROM (SELECT u, count(*) AS n FROM e GROUP BY 1) JOIN d ON d.node = u ORDER BY n DESC, u LIMIT 1""")
def largest_component(t):
    e = t.orders.select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") + 10000000).alias("v"), F.lit(1.0).alias("length_m"))
    labels = connected_components(e)
    top = network.largest_component(e, labels, by="nodes")
    size = network.component_sizes(e, labels).select("component", "nodes")
    return top.join(size, "component").join(network.degree(e).withColumnRenamed("node", "component"), "component").select("component", "nodes", "degree")


@query(f"""WITH RECURSIVE g AS ({_ROADS}), b AS (SELECT u AS a, v AS b FROM g WHERE cost < 10.5 UNION SELECT v, u FROM g WHERE cost < 10.5),
    w(n, d) USING KEY (n) AS (SELECT min(a), 0 FROM b UNION SELECT x.n, x.d FROM (SELECT b.b AS n, min(w.d) + 1 AS d FROM w JOIN b ON b.a = w.n GROUP BY 1) x LEFT JOIN recurring.w r ON r.n = x.n WHERE r.d IS NULL OR x.d < r.d)
    SELECT n::BIGINT AS node, d::INT AS depth FROM w""")
def bfs_depth(t):
    links = _roads(t).where("cost < 10.5").select("u", "v")
    first = paths.symmetric(links).agg(F.min("u").alias("node")).where("node is not null")
    return paths.bfs(links, first).select("node", "depth")


@query("SELECT DISTINCT node, dense_rank() OVER (ORDER BY node) - 1 AS id FROM (SELECT o_custkey AS node FROM orders)")
def dense_ids(t):
    return network.dense_ids(t.orders.select(F.col("o_custkey").alias("node")))


@query("""WITH e AS (SELECT l_orderkey AS edge, l_partkey AS u, 1000000 + l_suppkey AS v FROM lineitem),
          d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1""")
def degree_distribution(t):
    e = t.lineitem.select(F.col("l_partkey").alias("u"), (F.col("l_suppkey") + 1000000).alias("v"))
    return network.degree(e).groupBy("degree").agg(F.count("*").alias("n"))
