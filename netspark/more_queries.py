"""Further registered queries: operators on lines, areas, sheets, answers and whole runs, over shapes made of the tables.

Shapes are laid out so that SQL can say what must come out: axis-parallel lines, squares, chains.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions import answers as A
from netspark.functions import geometry as G
from netspark.functions import scalar as S
from netspark.functions import sheets
from netspark.operators import evidence, matched, national, network, paths, places, repair, reviews, search, spatial, surface
from netspark.operators.components import connected_components
from netspark.plans.iterate import cut, ensure_checkpoint_dir
from netspark.queries import _ROADS, _WAYS, _roads, query
from netspark.sources import geopackage, raster, readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, gone when the application ends."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _put(spark: SparkSession, path: str, body: bytes) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(body))
    out.close()


def _nations(t) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").cast("long").alias("k"), "n_name", F.col("n_regionkey").cast("long").alias("r"))


_N = "(SELECT n_nationkey::BIGINT AS k, n_name, n_regionkey::BIGINT AS r FROM nation)"
_p = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
_line = lambda *ps: F.array(*(_p(*p) for p in ps))


# ---- sources and sinks


@query("SELECT c_custkey, c_acctbal, 'kept' AS layer FROM customer UNION ALL SELECT c_custkey, c_acctbal, 'replaced' FROM customer WHERE c_acctbal > 0")
def layers_written_and_read(t):
    d, c = _folder(t.spark, "layers"), t.customer.select("c_custkey", "c_acctbal")
    writers.layer(c.where("c_custkey % 2 = 0"), d, "kept")
    writers.layer(c, d, "replaced")
    writers.layer(c.where("c_custkey % 2 = 1"), d, "kept", append=True)
    writers.layer(c.where("c_acctbal > 0"), d, "replaced")
    absent = readers.layer(t.spark, d, "absent", "c_custkey long, c_acctbal double")
    out = readers.layer(t.spark, d, "kept").withColumn("layer", F.lit("kept")).unionByName(readers.layer(t.spark, d, "replaced").withColumn("layer", F.lit("replaced")))
    return out.unionByName(absent.withColumn("layer", F.lit("absent")))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, NULL::VARCHAR AS note FROM supplier")
def csv_as_text(t):
    d = _folder(t.spark, "csv")
    t.supplier.select("s_suppkey", "s_name", F.lit("").alias("note")).write.csv(d, header=True, sep=";", emptyValue="")
    return readers.csv_text(t.spark, d, "s_suppkey string, s_name string, note string", sep=";")


@query("""SELECT n_nationkey::BIGINT AS source_row, n_name AS namn, y::INT AS year, CASE WHEN n_nationkey % 4 = 0 AND y = 1890 THEN NULL ELSE n_nationkey * (y - 1800) END::DOUBLE AS value
          FROM nation, (VALUES (1880), (1890)) v(y)""")
def csv_with_preamble_to_long_series(t):
    d = _folder(t.spark, "preamble")
    rows = [f"{r.n_name};{r.n_nationkey * 80};{'' if r.n_nationkey % 4 == 0 else r.n_nationkey * 90}" for r in t.nation.orderBy("n_nationkey").collect()]  # 25 rows
    _put(t.spark, f"{d}/a.csv", ("﻿" + "\n" * 6 + "namn ; y1880;y1890\n" + "\n".join(rows) + "\n").encode())
    wide = readers.csv_with_preamble(t.spark, readers.newest(t.spark, f"{d}/*.csv"))
    return surface.long_series(wide, ["source_row", "namn"]).withColumn("source_row", F.col("source_row").cast("long"))


@query("SELECT event_id, value, 'lenient' AS how FROM events UNION ALL SELECT event_id, value, 'strict' FROM events WHERE event_id % 3 = 0")
def json_lines(t):
    d, e = _folder(t.spark, "jsonl"), t.events.select("event_id", "value")
    writers.jsonl(e.where("event_id % 3 = 0"), f"{d}/strict")
    bad = F.when(F.col("event_id") % 7 == 0, F.concat(F.to_json(F.struct("event_id", "value")), F.lit("\nnot json {"))).otherwise(F.to_json(F.struct("event_id", "value")))
    e.select(bad.alias("value")).write.text(f"{d}/lenient")
    read = lambda how: readers.jsonl(t.spark, f"{d}/{how}", "event_id long, value double", strict=how == "strict").withColumn("how", F.lit(how))
    return read("lenient").unionByName(read("strict"))


@query("SELECT 0 AS round, 'none yet' AS note UNION ALL SELECT r_regionkey::INT, r_name FROM region")
def state_with_default(t):
    d = _folder(t.spark, "state")
    none = readers.state(t.spark, f"{d}/state", "round int, note string")
    writers.jsonl(t.region.select(F.col("r_regionkey").cast("int").alias("round"), F.col("r_name").alias("note")), f"{d}/state")
    first = t.spark.range(1).select(F.lit(0).alias("round"), F.lit("none yet").alias("note"))
    return first.where(F.lit(none.isEmpty())).unionByName(readers.state(t.spark, f"{d}/state", "round int, note string"))


@query("""SELECT (n_nationkey // 10 || chr(97 + n_nationkey % 10)) AS square, n_nationkey % 10 || 'b' AS sheet, 60 + n_regionkey AS edition, sha256(n_name) AS sha256, length(n_name)::BIGINT AS length
          FROM nation WHERE n_nationkey <> 3""")
def file_names_and_hashes(t):
    d = _folder(t.spark, "files")
    for r in t.nation.collect():  # 25 rows
        name = "readme.txt" if r.n_nationkey == 3 else f"133_{r.n_nationkey // 10}{chr(97 + r.n_nationkey % 10)}{r.n_nationkey % 10}b{60 + r.n_regionkey}_0_b2.tif"
        _put(t.spark, f"{d}/{name}", r.n_name.encode())
    files = readers.file_table(t.spark, f"{d}/*", r"^133_(\d+[a-z])(\d[a-j])(\d\d)_0_b2\.tif$", ["square", "sheet", "edition"])
    return files.join(readers.hashes(t.spark, f"{d}/*"), "path").select("square", "sheet", F.col("edition").cast("int").alias("edition"), "sha256", "length")


@query("SELECT r_regionkey::BIGINT AS n, upper(r_name) AS name, true AS dated FROM region")
def whole_json_documents_and_provenance(t):
    d = _folder(t.spark, "documents")
    for r in t.region.collect():  # 5 rows
        _put(t.spark, f"{d}/in/{r.r_regionkey}.json", json.dumps({"n": r.r_regionkey, "name": r.r_name}, indent=1).encode())
    writers.provenance(t.spark, f"{d}/made", "stage", "1", readers.hashes(t.spark, f"{d}/in/*.json"), {"b": 1, "a": 2})
    made = t.spark.read.text(f"{d}/made").select(F.from_json("value", "created string, inputs string").alias("m")).select((F.to_timestamp("m.created") <= F.current_timestamp()).alias("dated"))
    docs = readers.documents(t.spark, f"{d}/in/*.json").select(F.from_json("text", "n long, name string").alias("o"))
    return docs.select("o.n", F.upper("o.name").alias("name")).crossJoin(F.broadcast(made))  # one row


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'error: no header of ' || page_id ELSE 'ok' END AS status, CASE WHEN page_id % 5 <> 0 THEN length(url)::BIGINT END AS n FROM pages")
def headers_with_errors_as_rows(t):
    def read(path):
        page, url = path.split("\t")
        if int(page) % 5 == 0:
            raise ValueError(f"no header of {page}")
        return {"n": len(url)}

    rows = t.pages.select(F.concat_ws("\t", F.col("page_id").cast("string"), "url").alias("path"))
    return readers.headers(rows, read, "n long").select(F.split("path", "\t")[0].cast("long").alias("page_id"), "status", "n")


@query(f"SELECT k AS feature, 'LineString' AS kind, k + 1.0::DOUBLE AS length_m, 'name ' || k AS name FROM {_N}")
def geopackage_layer(t):
    import sqlite3
    import struct

    d, db = _folder(t.spark, "gpkg"), sqlite3.connect(":memory:")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('roads', 'shape')")
    db.execute("CREATE TABLE roads (fid INTEGER PRIMARY KEY, shape BLOB, name TEXT)")
    for r in t.nation.orderBy("n_nationkey").collect():  # 25 rows
        body = struct.pack("<BIIdddd", 1, 2, 2, 5.0, 5.0, 6.0 + r.n_nationkey, 5.0)
        db.execute("INSERT INTO roads VALUES (?, ?, ?)", [r.n_nationkey, b"GP\0\1" + struct.pack("<i", 3006) + body, f"name {r.n_nationkey}"])
    db.commit()
    _put(t.spark, f"{d}/a.gpkg", db.serialize())
    rows = geopackage.read(t.spark, f"{d}/a.gpkg", "roads")
    return rows.select("feature", "kind", G.length("geom").alias("length_m"), F.col("attributes")["name"].alias("name"))


@query(f"SELECT k, i::INT AS i, CASE WHEN (k + i) % 4 = 0 THEN NULL ELSE round(least(k, i * 2, 200) / 255.0::DOUBLE, 9) END AS grey, CASE WHEN (k + i) % 4 = 0 THEN NULL ELSE round(greatest(k, i * 2, 200) / 255.0::DOUBLE, 9) END AS bright FROM {_N}, range(8) g(i)")
def bands_to_grey_and_bright(t):
    i = F.sequence(F.lit(0), F.lit(7))
    no = lambda v: F.transform(i, lambda j: F.when((F.col("k") + j) % 4 == 0, 0).otherwise(v(j)).cast("int"))
    blocks = _nations(t).select("k", no(lambda j: F.col("k")).alias("r"), no(lambda j: j * 2).alias("g"), no(lambda j: F.lit(200)).alias("b"))
    out = raster.evidence_bands(blocks).select("k", F.posexplode(F.arrays_zip("grey", "bright")).alias("i", "p"))
    return out.select("k", "i", F.round("p.grey", 9).alias("grey"), F.round("p.bright", 9).alias("bright"))


def _checkered(t) -> DataFrame:
    """A sheet of 2 x 2 blocks of 10 x 10 pixels per nation; a pixel holds its column on the sheet."""
    b = _nations(t).select(F.col("n_name").alias("sheet"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("block"))
    b = b.select("*", (F.floor(F.col("block") / 2) * 10).cast("int").alias("row0"), (F.col("block") % 2 * 10).alias("col0"), F.lit(10).alias("width"), F.lit(10).alias("height"))
    return b.withColumn("r", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: (F.col("col0") + j % 10).cast("double")))


@query(f"SELECT k AS window, y::INT AS y, x::INT AS x, CASE WHEN x + k - 12 BETWEEN 0 AND 19 AND y + 15 < 20 THEN x + k - 12 ELSE 255 END::DOUBLE AS v FROM {_N}, range(6) a(x), range(8) b(y)")
def window_over_the_border(t):
    wanted = _nations(t).select(F.col("k").alias("window"), F.col("n_name").alias("sheet"), (F.col("k") - 12).cast("int").alias("col"), F.lit(15).alias("row"), F.lit(6).alias("w"), F.lit(8).alias("h"), F.lit(6).alias("out_w"), F.lit(8).alias("out_h"))
    out = raster.windows(wanted, _checkered(t), ("r",))
    return out.select("window", F.posexplode("r").alias("i", "v")).select("window", F.floor(F.col("i") / 6).cast("int").alias("y"), (F.col("i") % 6).alias("x"), "v")


@query(f"SELECT k AS window, 8 AS width, 8 AS height, 10.0::DOUBLE + k % 5 AS middle, (13 + k % 5)::DOUBLE AS last FROM {_N}")
def crops_about_points(t):
    sheets_ = _nations(t).select(F.col("n_name").alias("sheet"), F.lit(1000.0).alias("xmin"), F.lit(2000.0).alias("ymax"), F.lit(2.0).alias("res"))
    at = _nations(t).select(F.col("k").alias("window"), F.col("n_name").alias("sheet"), (1000.0 + 2 * (10 + F.col("k") % 5)).alias("x"), F.lit(1980.0).alias("y"))
    out = raster.crops(at, sheets_, _checkered(t), size_m=16.0, pixels=8, bands=("r",))
    return out.select("window", "width", "height", F.col("r")[28].alias("middle"), F.col("r")[31].alias("last"))


# ---- projections, predicates, text


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def dropped_columns(t):
    return t.orders.drop("o_orderstatus", "o_orderdate", "o_orderpriority", "no_such_column")


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN false ELSE true END AS finite, event_id % 11 = 0 AS open_start, event_id % 13 = 0 AS open_end FROM events""")
def finite_and_sentinels(t):
    x = F.when(F.col("event_id") % 5 == 0, float("nan")).when(F.col("event_id") % 5 == 1, float("-inf")).otherwise(F.lit(1.5))
    e = t.events.select("event_id", S.finite(x).alias("finite"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(1880).alias("start"), F.when(F.col("event_id") % 13 == 0, 9999).otherwise(1900).alias("end"))
    return e.select("event_id", "finite", *surface.sentinels())


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS first, substr(p_brand, 4, 2) AS slice, regexp_replace(p_brand, '^Brand', '') AS rest,
          'part ' || p_partkey || ' of ' || p_brand || ': ' || p_partkey AS filled, 'x/' || p_partkey AS relative, regexp_matches(p_brand, '^[A-Za-z0-9_-]{1,32}$') AS id_ok,
          '{"a":' || p_partkey || ',"b":"' || p_brand || '"}' AS json FROM part""")
def text_functions(t):
    one = F.array_join(F.slice(F.split(S.title_case("p_name"), ""), 1, 1 << 20), "")
    first = F.concat(F.substring(one, 1, 1), F.lower(F.substring(one, 2, 1 << 20)))
    return t.part.select(
        "p_partkey", first.alias("first"), F.substring("p_brand", 4, 2).alias("slice"), S.without_prefix("p_brand", "Brand").alias("rest"),
        S.filled("part {KEY} of {BRAND}: {KEY}", {"KEY": F.col("p_partkey"), "BRAND": F.col("p_brand")}).alias("filled"),
        S.relative_path(F.concat(F.lit("/data/root/x/"), F.col("p_partkey").cast("string")), "/data/root").alias("relative"),
        F.col("p_brand").rlike(A.ID_PATTERN).alias("id_ok"), F.to_json(F.struct(F.col("p_partkey").alias("a"), F.col("p_brand").alias("b"))).alias("json"),
    )


@query("SELECT c_custkey, 'Åbo-' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS name FROM customer")
def title_case_after_hyphens(t):
    return t.customer.select("c_custkey", S.title_case(F.concat(F.lit("ÅBO-"), F.lower("c_mktsegment"))).alias("name"))


@query("SELECT o_orderkey, o_orderkey % 50 AS ix, -(o_orderkey % 7) AS iy, o_orderkey::INT AS n FROM orders")
def names_parsed(t):
    name = F.format_string("cor_e%04d_n-%d x%d", F.col("o_orderkey") % 50, F.col("o_orderkey") % 7, F.col("o_orderkey"))
    ix, iy, n = S.parsed(name, r"cor_e(\d{4})_n(-\d+) x(\d+)", "bigint", "bigint", "int")
    return t.orders.select("o_orderkey", ix.alias("ix"), iy.alias("iy"), F.coalesce(S.strict_number(F.lit(" ")), n).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) AS half, l_quantity / 1000.0 / 5 * 60 AS minutes FROM lineitem")
def half_even_and_minutes(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", S.half_even(F.col("l_quantity") / 2).alias("half"), places.minutes(F.col("l_quantity"), 5.0).alias("minutes"))


@query("SELECT 50 AS n, 50 AS different, 50 AS known")
def seeded_sample(t):
    s, again = (S.sampled(t.customer.repartition(k).select("c_custkey"), "c_custkey", 50, seed=7) for k in (3, 5))
    known = s.join(again.select("c_custkey"), "c_custkey", "left_semi")
    return known.agg(F.count("*").cast("int").alias("n"), F.countDistinct("c_custkey").cast("int").alias("different")).withColumn("known", F.col("n"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS debts FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def rollup_and_boolean_sums(t):
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum((F.col("c_acctbal") < 0).cast("int")).alias("debts"))


@query("SELECT CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS grp, count(*) AS n, string_agg(DISTINCT c_nationkey::VARCHAR, ',' ORDER BY c_nationkey::VARCHAR) AS members FROM customer GROUP BY 1")
def null_groups_and_sets(t):
    g = t.customer.select(F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("grp"), "c_nationkey")
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("c_nationkey").cast("string"))), ",").alias("members"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber) AS nth FROM lineitem WHERE l_partkey <> l_suppkey)
          SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, l_extendedprice AS cost, l_orderkey * 10 + l_linenumber AS edge FROM r WHERE nth = 1""")
def cheapest_edge_rows(t):
    return paths.cheapest(t.lineitem.select(F.col("l_partkey").alias("u"), F.col("l_suppkey").alias("v"), F.col("l_extendedprice").alias("cost"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge")))


@query("SELECT o_custkey, o_orderkey, nth FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS nth FROM orders) WHERE nth <= 2")
def ranked_alternatives(t):
    return national.ranked(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", "nth")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_per_key(t):
    return surface.unique_or_raise(surface.first_by(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey"), ["o_custkey"])


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""WITH a AS (SELECT c_nationkey AS zone, sum(c_acctbal) AS a FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS zone, sum(s_acctbal) AS b FROM supplier GROUP BY 1)
          SELECT zone, round((a - b) / (SELECT quantile_cont(b, 0.99) FROM b), 6) AS difference FROM a JOIN b USING (zone)""")
def scenario_difference(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum("c_acctbal").alias("accessibility"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum("s_acctbal").alias("accessibility"))
    return network.scenario_difference(a, b).withColumn("difference", F.round("difference", 6))


@query("SELECT o_custkey AS unit, CASE WHEN count(*) FILTER (year(o_orderdate) = 1993) > 0 THEN round(sum(o_totalprice) FILTER (year(o_orderdate) = 1993), 2) END AS population FROM orders GROUP BY 1")
def population_at_a_year(t):
    series = t.orders.select(F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"))
    return surface.population_at(series, series.select("unit").distinct(), 1993).withColumn("population", F.round("population", 2))


@query("""WITH n AS (SELECT s_suppkey, s_nationkey AS n FROM supplier) SELECT s_suppkey, greatest(abs(n // 5 - 2), abs(n % 5 - 3))::BIGINT AS rings FROM n""")
def chebyshev_rings(t):
    k = F.col("s_nationkey")
    s = t.supplier.select("s_suppkey", (F.floor(k / 5) * search.PACK + k % 5).cast("long").alias("a"), F.lit(2 * search.PACK + 3).cast("long").alias("b"))
    return s.select("s_suppkey", search.chebyshev("a", "b").cast("long").alias("rings"))


# ---- lines and areas


def _level(t) -> DataFrame:
    """Level lines, one a supplier; two of them of several vertices."""
    s = t.supplier.select(F.col("s_suppkey").alias("line_id"), F.col("s_nationkey").cast("long").alias("way"), (F.col("s_suppkey") * 30.0).alias("y"), (F.col("s_nationkey") * 10.0).alias("x"))
    return s.select("line_id", "way", F.array(_p("x", "y"), _p("x + 150", "y"), _p("x + 400", "y")).alias("geom"))


_H = "(SELECT s_suppkey AS h, s_nationkey::BIGINT AS way, s_suppkey * 30.0::DOUBLE AS hy, s_nationkey * 10.0::DOUBLE AS x1, s_nationkey * 10.0::DOUBLE + 400 AS x2 FROM supplier)"
_V = f"(SELECT 1000000 + k AS v, k * 25.0::DOUBLE + 7 AS vx, k * 20.0::DOUBLE AS y1, k * 20.0::DOUBLE + 905 AS y2 FROM {_N})"


def _upright(t) -> DataFrame:
    return _nations(t).select((F.col("k") + 1000000).alias("line_id"), _line(("k * 25 + 7", "k * 20"), ("k * 25 + 7", "k * 20 + 905")).alias("geom"))


@query(f"SELECT h AS a, v AS b, round(vx - x1, 4) AS at_a, round(hy - y1, 4) AS at_b FROM {_H}, {_V} WHERE vx BETWEEN x1 AND x2 AND hy BETWEEN y1 AND y2")
def line_crossings(t):
    x = spatial.crossings(_level(t).select("line_id", "geom").unionByName(_upright(t)), 50.0)
    return x.select("a", "b", F.round("at_a", 4).alias("at_a"), F.round("at_b", 4).alias("at_b"))


def _spots(t) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.select(c.alias("id"), F.col("c_nationkey").cast("long").alias("way"), (c * 37 % 650).cast("double").alias("x"), (c * 53 % 3001).cast("double").alias("y"))


_SPOTS = "(SELECT c_custkey AS id, c_nationkey::BIGINT AS pw, (c_custkey * 37 % 650)::DOUBLE AS x, (c_custkey * 53 % 3001)::DOUBLE AS y FROM customer)"
_AWAY = "sqrt(greatest(x1 - x, x - x2, 0) ** 2 + (y - hy) ** 2)"


@query(f"SELECT id, h AS line, round({_AWAY}, 4) AS dist, round(least(greatest(x - x1, 0), 400), 4) AS at FROM {_SPOTS}, {_H} WHERE {_AWAY} <= 20")
def points_near_lines(t):
    return spatial.points_near_lines(_spots(t), _level(t), 20.0).withColumns({"dist": F.round("dist", 4), "at": F.round("at", 4)})


@query(f"SELECT id, h AS line, round({_AWAY}, 4) AS dist FROM {_SPOTS} JOIN {_H} ON way = pw WHERE {_AWAY} <= 300 QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_AWAY}, h) = 1")
def nearest_line_of_the_same_way(t):
    return spatial.nearest_line(_spots(t), _level(t), 300.0, same="way").select("id", "line", F.round("dist", 4).alias("dist"))


@query(f"""WITH p AS (SELECT id, pw, x, y FROM {_SPOTS}), d AS (SELECT a.pw AS way, a.id AS a_id, b.id AS b_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.pw = b.pw AND a.id % 2 = 0 AND b.id % 2 = 1),
           r AS (SELECT *, row_number() OVER (PARTITION BY way, a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY way, b_id ORDER BY d, a_id) AS rb FROM d WHERE d <= 200)
           SELECT way, a_id, b_id, round(d, 4) AS dist FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nearest_within_keys(t):
    p = _spots(t)
    return spatial.mutual_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 200.0, ("way",)).withColumn("dist", F.round("dist", 4))


@query(f"SELECT a.k AS u, b.k AS v, a.k * 10.0::DOUBLE AS x1, a.r * 5.0::DOUBLE AS y1, b.k * 10.0::DOUBLE AS x2, b.r * 5.0::DOUBLE AS y2 FROM {_N} a JOIN {_N} b ON b.k = a.k + 1")
def edge_coordinates(t):
    n = _nations(t)
    e = n.where(f"k < {n.count() - 1}").select(F.col("k").alias("u"), (F.col("k") + 1).alias("v"))
    return spatial.coordinates(e, n.select(F.col("k").alias("node"), (F.col("k") * 10.0).alias("x"), (F.col("r") * 5.0).alias("y")))


def _square(k, x: str, y: str, size: str, where: DataFrame) -> DataFrame:
    ring = F.array(_p(x, y), _p(f"{x} + {size}", y), _p(f"{x} + {size}", f"{y} + {size}"), _p(x, f"{y} + {size}"), _p(x, y))
    return where.select(F.col(k).alias("polygon_id"), F.array(ring).alias("polygon"))


@query(f"SELECT a.k AS a_id, b.s_suppkey AS b_id FROM {_N} a JOIN supplier b ON a.k % 5 * 100 <= b.s_nationkey * 20 + 30 AND a.k % 5 * 100 + 70 >= b.s_nationkey * 20 AND a.k // 5 * 100 <= b.s_suppkey * 7 % 500 + 30 AND a.k // 5 * 100 + 70 >= b.s_suppkey * 7 % 500")
def polygons_that_meet(t):
    a = _square("k", "k % 5 * 100", "floor(k / 5) * 100", "70", _nations(t))
    return spatial.polygons_meeting(a, _square("s_suppkey", "s_nationkey * 20", "s_suppkey * 7 % 500", "30", t.supplier), 100.0)


@query(f"SELECT id FROM {_SPOTS} WHERE EXISTS (SELECT 1 FROM {_N} WHERE x >= k % 5 * 100 AND x < k % 5 * 100 + 70 AND y >= k // 5 * 100 AND y < k // 5 * 100 + 70)")
def points_in_any_polygon(t):
    return spatial.points_in_any(_spots(t), _square("k", "k % 5 * 100", "floor(k / 5) * 100", "70", _nations(t)), 100.0).select("id")


def _bent(t) -> DataFrame:
    """From (0, 0) level to (k + 1, 0), then up to (k + 1, s_suppkey)."""
    return t.supplier.select(F.col("s_suppkey").alias("line_id"), (F.col("s_nationkey") + 1).cast("double").alias("a"), F.col("s_suppkey").cast("double").alias("b")).withColumn("geom", _line(("0", "0"), ("a", "0"), ("a", "b")))


_BENT = "(SELECT s_suppkey AS line_id, (s_nationkey + 1)::DOUBLE AS a, s_suppkey::DOUBLE AS b FROM supplier)"
_ON = lambda d: f"round(least({d}, a), 5) AS x, round(greatest({d} - a, 0), 5) AS y"


@query(f"SELECT line_id, 'middle' AS what, {_ON('((a + b) / 2)')} FROM {_BENT} UNION ALL SELECT line_id, 'third', {_ON('((a + b) / 3)')} FROM {_BENT} UNION ALL SELECT line_id, 'start', 0, 0 FROM {_BENT} UNION ALL SELECT line_id, 'end', a, b FROM {_BENT} UNION ALL SELECT line_id, 'box', a, b FROM {_BENT}")
def points_along_lines(t):
    b = G.bounds("geom")
    parts = {"middle": G.midpoint("geom"), "third": G.point_at("geom", G.length("geom") / 3), "start": G.start("geom"), "end": G.end("geom"), "box": F.struct(b[2].alias("x"), b[3].alias("y"))}
    of = F.explode(F.array(*(F.struct(F.lit(k).alias("what"), v["x"].alias("x"), v["y"].alias("y")) for k, v in parts.items())))
    return _bent(t).select("line_id", of.alias("p")).select("line_id", "p.what", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query(f"SELECT line_id || '_0_' || i AS edge_id, round((a + b) / ceil((a + b) / 10), 4) AS length_m, ceil(a / 4)::INT + greatest(ceil(b / 4), 1)::INT + 1 AS vertices FROM {_BENT}, LATERAL (SELECT unnest(range(ceil((a + b) / 10)::BIGINT)) AS i)")
def equal_pieces_of_lines(t):
    dealt = _bent(t).repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "line_id")  # else one file's lines get their vertices in one task
    lines = dealt.withColumn("vertices", F.size(G.segmentised("geom", F.lit(4.0))))
    return spatial.build_edges(lines, 10.0, keep=("vertices",)).select("edge_id", F.round("length_m", 4).alias("length_m"), "vertices")


@query(f"SELECT line_id || '_0_0' AS edge_id, round(least(a, 9) - 2 + CASE WHEN a < 9 THEN least(b, 5) ELSE 0 END, 4) AS length_m FROM {_BENT} WHERE a > 2.5")
def lines_clipped_to_a_footprint(t):
    box = t.spark.range(1).select(F.array(_line(("2", "-5"), ("9", "-5"), ("9", "5"), ("2", "5"), ("2", "-5"))).alias("polygon"))
    return spatial.build_edges(_bent(t).where("a > 2.5 and a <> 9"), 250.0, footprint=box).unionByName(spatial.build_edges(_bent(t).where("a = 9").withColumn("geom", _line(("0", "0"), ("9", "0"))), 250.0, footprint=box)).select("edge_id", F.round("length_m", 4).alias("length_m"))


@query(f"SELECT k, k % 3 <> 0 AS simple, (k + 1.0)::DOUBLE AS hausdorff, (k + 1.0)::DOUBLE AS mean, 1 + k // 2 AS kept, round(sqrt(greatest(k - 10, 0) ** 2 + (5 + k) ** 2), 5) AS gap FROM {_N}")
def shapes_of_lines(t):
    bow = F.when(F.col("k") % 3 == 0, _line(("0", "0"), ("2", "2"), ("2", "0"), ("0", "2"))).otherwise(_line(("0", "0"), ("2", "0"), ("2", "2"), ("0", "2")))
    off = G.course_offset(F.col("beside"), F.col("level"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k")), lambda i: F.struct((i * 0.3).alias("x"), F.lit(0.0).alias("y")))
    n = _nations(t).withColumns({"level": _line(("0", "0"), ("10", "0")), "beside": _line(("0", "k + 1"), ("10", "k + 1")), "up": _line(("k", "5 + k"), ("k + 3", "5 + k"))})
    n = n.select("k", G.simple(bow).alias("simple"), off.alias("o"), G.thinned(dense, F.lit(0.5)).alias("kept"), G.closest("level", "up").alias("c"))
    return n.select("k", "simple", "o.hausdorff", F.round("o.mean", 9).alias("mean"), F.size("kept").cast("long").alias("kept"), F.round("c.dist", 5).alias("gap"))


@query(f"SELECT k, (k + 1.0) * (k + 1) - CASE WHEN k > 4 THEN 4 ELSE 0 END AS area, true AS valid, CASE WHEN k = 5 THEN 2 ELSE (k + 1) / 2.0 END AS y FROM {_N}")
def areas_and_inner_points(t):
    hole = F.when(F.col("k") > 4, F.array(_line(("1", "1"), ("3", "1"), ("3", "3"), ("1", "3"), ("1", "1")))).otherwise(F.array().cast(G.LINES))
    s = _square("k", "0", "0", "k + 1", _nations(t)).withColumnRenamed("polygon_id", "k").withColumn("polygon", F.concat("polygon", hole))
    s = s.withColumn("at", G.representative_point("polygon"))
    good = G.valid_polygon("polygon") & G.inside(F.col("at.x"), F.col("at.y"), F.col("polygon"))
    return s.select("k", G.area("polygon").alias("area"), good.alias("valid"), F.col("at.y").alias("y"))


@query(f"SELECT k AS id, round(100 + 2 * k - 0.5 * k, 6) AS x, round(50 - 3.0 * k, 6) AS y FROM {_N}")
def waypoints_to_map(t):
    m = (2.0, -0.5, 100.0, 0.0, -3.0, 50.0)
    w = _nations(t).select("k", F.array(F.array(F.col("k").cast("double"), F.col("k").cast("double")), F.array(F.lit(0.0), F.lit(0.0))).alias("w"))
    return w.select(F.col("k").alias("id"), G.polyline("w", m)[0].alias("p")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"SELECT k, (1200000 + 50000 * (k % 26) + 5000 * (k % 10))::DOUBLE AS xmin, (6050000 + 50000 * k + 5000 * (k % 7))::DOUBLE AS ymin FROM {_N}")
def sheet_grid(t):
    name = F.concat(F.col("k").cast("string"), F.char(65 + F.col("k") % 26), F.lit(" "), (F.col("k") % 7).cast("string"), F.char(97 + F.col("k") % 10))
    box = sheets.sheet_box("name")
    return _nations(t).withColumn("name", name).select("k", box[0], box[1])


# ---- snapping, seams, exits


@query(f"""WITH h AS (SELECT k, k * 1000.0 AS y, k % 3 AS kind FROM {_N})
           SELECT k AS part, CASE kind WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 4 END AS pieces, CASE kind WHEN 0 THEN 1 ELSE 0 END AS connectors, CASE kind WHEN 1 THEN 2 ELSE 1 END AS components FROM h""")
def snap_and_split(t):
    n = _nations(t).withColumn("y", F.col("k") * 5000)
    low = F.when(F.col("k") % 3 == 0, F.col("y") + 30).when(F.col("k") % 3 == 1, F.col("y") + 60).otherwise(F.col("y") - 500)
    up = F.struct(F.lit(500.0).alias("x"), low.cast("double").alias("y")), F.struct(F.lit(500.0).alias("x"), (F.col("y") + 600.0).alias("y"))
    lines = n.select((F.col("k") * 2).alias("line_id"), _line(("0", "y"), ("1000", "y")).alias("geom")).unionByName(n.select((F.col("k") * 2 + 1).alias("line_id"), F.array(*up).alias("geom")))
    out = cut(spatial.snap_ends(lines).withColumn("part", F.floor(F.col("line_id") / 2).cast("long")))
    nodes, edges = spatial.graph_of(out)
    labels = connected_components(edges).join(nodes, "node").select(F.floor((F.col("y") + 1000) / 5000).cast("long").alias("part"), "component")
    return out.groupBy("part").agg(F.count_if(~F.col("is_connector")).cast("int").alias("pieces"), F.count_if(F.col("is_connector")).cast("int").alias("connectors")).join(labels.groupBy("part").agg(F.countDistinct("component").cast("int").alias("components")), "part")


def _tiles(t) -> DataFrame:
    x, y = F.col("k") % 5 * 500.0, F.floor(F.col("k") / 5) * 500.0
    return _nations(t).select(F.format_string("t%02d", "k").alias("tile_id"), x.alias("xmin"), y.cast("double").alias("ymin"), (x + 500).alias("xmax"), (y + 500).cast("double").alias("ymax"), "k")


@query(f"SELECT printf('t%02d', a.k) AS tile_a, printf('t%02d', b.k) AS tile_b FROM {_N} a JOIN {_N} b ON (b.k = a.k + 1 AND b.k % 5 <> 0) OR b.k = a.k + 5")
def shared_tile_edges(t):
    return spatial.shared_edges(_tiles(t)).select("tile_a", "tile_b")


_EAST = f"(SELECT a.k FROM {_N} a JOIN {_N} b ON b.k = a.k + 1 AND b.k % 5 <> 0)"


@query(f"SELECT 'join' AS what, printf('t%02d', k) AS tile, printf('r%d', k) AS feature FROM {_EAST} WHERE k % 3 <> 0 UNION ALL SELECT 'gap', printf('t%02d', k), printf('r%d', k) FROM {_EAST} WHERE k % 3 = 0 UNION ALL SELECT 'gap', printf('t%02d', k + 1), printf('l%d', k + 1) FROM {_EAST} WHERE k % 3 = 0")
def seams_stitched(t):
    """Every tile has a line from near its west side and one to near its east side; a third of the seams lie too far apart."""
    r = _tiles(t)
    right = r.where("xmax < 2400").select("tile_id", F.format_string("r%d", "k").alias("product_feature_id"), F.array(_p("xmax - 100", "ymin + 200"), _p("xmax - 5", "ymin + 200")).alias("geom"))
    left = r.where("xmin > 100").withColumn("k0", F.col("k") - 1).withColumn("dy", F.when(F.col("k0") % 3 == 0, 100).otherwise(2))
    left = left.select("tile_id", F.format_string("l%d", "k").alias("product_feature_id"), F.array(_p("xmin + 8", "ymin + 200 + dy"), _p("xmin + 100", "ymin + 200 + dy")).alias("geom"))
    joins, gaps = spatial.stitch(_tiles(t), right.unionByName(left))
    return joins.select(F.lit("join").alias("what"), F.col("tile_a").alias("tile"), F.col("feature_a").alias("feature")).unionByName(gaps.select(F.lit("gap").alias("what"), F.col("tile_id").alias("tile"), "feature"))


@query(f"SELECT tile_id, side FROM (SELECT printf('t%02d', k) AS tile_id, unnest(CASE WHEN k % 4 = 0 THEN ['e'] WHEN k % 4 = 1 THEN ['n', 'w'] WHEN k % 4 = 2 THEN ['s'] ELSE [] END) AS side FROM {_N})")
def tile_exits(t):
    end = F.when(F.col("k") % 4 == 0, _p("xmax - 20", "ymin + 250")).when(F.col("k") % 4 == 1, _p("xmin + 1", "ymax - 1")).when(F.col("k") % 4 == 2, _p("xmin + 250", "ymin")).otherwise(_p("xmin + 100", "ymin + 100"))
    lines = _tiles(t).select("tile_id", F.array(_p("xmin + 250", "ymin + 250"), end).alias("geom"))
    return search.exits(lines, _tiles(t).drop("k"))
