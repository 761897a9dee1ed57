import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from netspark.functions import answers as A
from netspark.functions.geometry import LINE
from netspark.operators import evidence, reviews, search, surface
from netspark.sources import readers, writers
from netspark.streaming import answers as stream

PROV = {k: "x" for k in A.PROVENANCE_FIELDS}


def docs_of(spark, *texts):
    return A.documents(spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(texts)], "tile_id string, text string"))


def test_objects_in_text(spark):
    got = docs_of(spark, '{"a": 1}', 'Here it is:\n```json\n{"a": 2}\n```\nbye', 'so {"a": 3} then', "[1]", None, "```json\nno\n``` ```\n{\"b\": {}}\n```", "")
    rows = got.orderBy("tile_id").collect()
    assert [(r.object, r.wrapped) for r in rows] == [('{"a": 1}', False), ('{"a": 2}', True), ('{"a": 3}', True), (None, None), (None, None), ('{"b": {}}', True), (None, None)]
    assert {(r.kind, r.tile_id) for r in A.deviations(got, A.PASS_A).where("key = '<document>'").collect()} >= {("no_json_object", "t3"), ("answer_not_bare_json", "t1")}


def test_aliases_vocabularies_and_defaults(spark):
    raw = {"tile_id": "x", "more": 1, "features": [{"id": "a", "class": "Single_Line", "points": [[0, 0], [5, 2000]], "endpoint_flags": ["obscured", "junction"], "colour": "red", "alternatives": ["or a fence", {"note": "n", "class": "k", "odd": 1}, 5]}, 7, {"feature_id": "a", "waypoints_uv": [[1, 2], [3]], "proposed_class": 5, "junction_ids": "no", "evidence_note": "e" * 301, "uncertainty_note": 3}], "junctions": [{"branch_count": 2, "uv": [1, True]}]}
    docs = docs_of(spark, json.dumps(raw))
    f = A.features(docs).where("ord = 0").first()
    assert f.feature_id == "a" and f.proposed_class == "single_line" and json.loads(f.extra) == {"colour": "red"} and f.endpoint_flags == ["unknown", "junction"]
    assert [json.loads(x) for x in f.alternatives] == [{"note": "or a fence", "raw": "or a fence"}, {"note": "n", "proposed_class": "k"}]
    assert f.waypoints_uv == [[0, 0], [5, 2000]] and f.waypoints_ok and not A.features(docs).where("ord = 2").first().waypoints_ok
    found = {(r.scope, r.object_id, r.key, r.kind) for r in A.deviations(docs, A.PASS_A).collect()}
    assert found == {
        ("top", "t0", "more", "extra_key"), ("top", "t0", "tile_id", "tile_id_mismatch"),
        ("feature", "a", "id", "renamed_key"), ("feature", "a", "class", "renamed_key"), ("feature", "a", "points", "renamed_key"), ("feature", "a", "colour", "extra_key"),
        ("feature", "a", "junction_ids", "missing_key"), ("feature", "a", "evidence_note", "missing_key"), ("feature", "a", "uncertainty_note", "missing_key"),
        ("feature", "a", "waypoints_uv", "coordinate_out_of_range"), ("feature", "a", "proposed_class", "class_case_normalised"), ("feature", "a", "endpoint_flags", "endpoint_flag_not_in_vocabulary"),
        ("feature", "a", "alternatives", "alternative_not_an_object"), ("feature", "a", "alternatives", "wrong_type"), ("feature", "a", "alternatives[1].class", "renamed_key"),
        ("feature", "a", "alternatives[1].odd", "extra_key"), ("feature", "a", "alternatives[1].kind", "missing_key"),
        ("feature", "<item-01>", "<feature>", "wrong_type"),
        ("feature", "a", "feature_id", "duplicate_feature_id"), ("feature", "a", "endpoint_flags", "missing_key"), ("feature", "a", "waypoints_uv", "wrong_type"), ("feature", "a", "proposed_class", "class_not_in_vocabulary"),
        ("feature", "a", "junction_ids", "wrong_type"), ("feature", "a", "evidence_note", "note_too_long"), ("feature", "a", "uncertainty_note", "wrong_type"),
        ("junction", "<unnamed-00>", "branch_count", "renamed_key"), ("junction", "<unnamed-00>", "junction_id", "missing_key"), ("junction", "<unnamed-00>", "evidence_note", "missing_key"),
        ("junction", "<unnamed-00>", "uv", "non_numeric_coordinate"), ("junction", "<unnamed-00>", "n_branches", "value_out_of_range"),
    }


def test_reviews_and_disputes(spark):
    raw = {"tile_id": "t0", "features": [], "reviews": [{"id": "a", "verdict": "Agree", "evidence": "x"}, {"id": "a", "verdict": "maybe", "class": "Dashed_Line", "corrected_polyline": [[0, 0], [2, 2]], "evidence_note": ""}, {"reviewed_feature_id": "b", "verdict": "partly_agree_course_differs", "evidence_note": "", "corrected_waypoints_uv": []}], "contested_junctions": [{"what_is_contested": "a branch too many", "coordinate": [1, 2], "evidence": ""}]}
    docs = docs_of(spark, json.dumps(raw))
    rows = [(r.reviewed_feature_id, r.verdict, r.proposed_class, r.corrected_ok) for r in A.reviews(docs).orderBy("ord").collect()]
    assert rows == [("a", "agree", "", False), ("a", "cannot_tell", "dashed_line", True), ("b", "partly_agree_course_differs", "", False)]
    c = A.contested(docs).first()
    assert (c.object_id, c.what_is_disputed, c.what_is_disputed_note, c.uv) == ("cj00", "unknown", "a branch too many", [1, 2])
    kinds = sorted(r.kind for r in A.deviations(docs, A.PASS_C).where("kind <> 'renamed_key'").collect())
    assert kinds == ["class_case_normalised", "contested_kind_not_in_vocabulary", "correction_missing", "duplicate_reviewed_feature_id", "verdict_case_normalised", "verdict_not_in_vocabulary"]


def test_deviations_read_the_documents_twice_at_most(spark, tmp_path):
    """Once for everything and once for ids that repeat; no filter opens JSON again."""
    spark.createDataFrame([("t", '{"tile_id":"t","features":[{"id":"a"},{"id":"a"}],"junctions":[]}')], "tile_id string, text string").write.parquet(f"{tmp_path}/answers")
    got = A.deviations(A.documents(spark.read.parquet(f"{tmp_path}/answers")), A.PASS_A)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x for x in plan) <= 2
    assert not [x for x in plan if "Filter" in x and ("from_json" in x or "parse" in x)]
    assert got.where("kind = 'duplicate_feature_id'").count() == 1


def test_ids_repeat_within_a_tile_and_elements_may_be_text(spark):
    one, two = ('{"tile_id":"t","junctions":[],"features":[%s]}' % x for x in ('{"id":"a"},"{\\"id\\":\\"a\\"}",{"id":"b"}', '{"id":"a"},{"id":"a"},{"id":"c","feature_id":"b"},"\\u007b"'))
    docs = A.documents(spark.createDataFrame([("t", one), ("t", two), ("s", one)], "tile_id string, text string"))
    rows = A.deviations(docs, A.PASS_A).where("kind = 'duplicate_feature_id' or key = '<feature>'").collect()
    assert sorted((r.tile_id, r.object_id, r.detail) for r in rows) == [("s", "<item-01>", "STRING instead of an object"), ("t", "<item-01>", "STRING instead of an object"), ("t", "<item-03>", "STRING instead of an object"), ("t", "a", "a again"), ("t", "a", "a again"), ("t", "b", "b again")]


def test_missing_fields_come_first(spark):
    rows = spark.createDataFrame([("t", 0, "f", "A", [[0.0, 0.0], [1.0, 1.0]], "unknown"), ("t", 1, None, "A", None, "unknown")], "tile_id string, ord int, feature_id string, pass string, waypoints_uv array<array<double>>, proposed_class string")
    tiles = spark.createDataFrame([("t", 9.0, 9.0)], "tile_id string, display_w double, display_h double")
    good, bad = reviews.validate(rows, tiles)
    lack = "model_family,junction_ids,endpoint_flags,evidence_note,uncertainty_note,provenance"
    assert good.count() == 0 and {r.reason for r in bad.collect()} == {f"missing_fields:{lack}", "missing_fields:feature_id," + lack.replace("model_family,", "model_family,waypoints_uv,")}


def feature(i, points=((0, 0), (10, 0)), cls="single_line"):
    return {"feature_id": i, "waypoints_uv": [list(p) for p in points], "proposed_class": cls, "junction_ids": [], "endpoint_flags": ["dead_end", "junction"], "evidence_note": "", "uncertainty_note": ""}


def review(i, verdict, **more):
    return {"reviewed_feature_id": i, "verdict": verdict, "evidence_note": "", **more}


def test_tile_products(spark):
    a = {"tile_id": "t", "junctions": [], "features": [
        feature("ok"), feature("cls"), feature("moved"), feature("gone"), feature("unsure"), feature("lost"), feature("nofix"), feature("ok"),
        feature("out", [(0, 0), (1001, 0)]), feature("cross", [(0, 0), (2, 2), (2, 0), (0, 2)]), feature("zero", [(1, 1), (1, 1)]), feature("bad", [(0, 0)]),
    ]}
    c = {"tile_id": "t", "contested_junctions": [], "features": [feature("new", cls="dashed_line")], "reviews": [
        review("ok", "cannot_tell"), review("ok", "AGREE"), review("cls", "agree_with_different_class", proposed_class="dashed_line"),
        review("moved", "partly_agree_course_differs", corrected_waypoints_uv=[[0, 1], [10, 1]]), review("gone", "disagree_not_a_road"),
        review("unsure", "no idea"), review("nofix", "partly_agree_course_differs"), review("nobody", "agree"), review("out", "agree"),
    ]}
    df = spark.createDataFrame([("t", "```\n" + json.dumps(a) + "\n```", json.dumps(c)), ("u", "{}", "no json")], "tile_id string, pass_a string, pass_c string")
    tiles = df.select("tile_id", F.lit(1000.0).alias("display_w"), F.lit(1000.0).alias("display_h"))
    out = {k: v.collect() for k, v in reviews.tile_products(df, tiles, "p", "r", PROV).items()}
    assert {r.feature_id: r.provenance_kind for r in out["product"]} == {"ok": "pass_a_kept_agreed", "cls": "pass_a_kept_class_contested", "moved": "course_corrected_by_reviewer", "new": "added_by_reviewer"}
    assert {r.feature_id: r.reason for r in out["excluded"]} == {"gone": "reviewer_says_not_a_road", "unsure": "reviewer_cannot_tell", "lost": "no_review_returned", "nofix": "course_differs_but_no_correction_given"}
    assert {(r.feature_id, r.reason) for r in out["rejected"]} == {("ok", "duplicate_feature_id"), ("out", "coordinate_outside_map_face"), ("cross", "self_intersection"), ("zero", "zero_length"), ("bad", "waypoints_not_a_polyline")}
    assert {r.reviewed_feature_id for r in out["unmatched"]} == {"nobody", "out"}
    moved = next(r for r in out["product"] if r.feature_id == "moved")
    assert [tuple(p) for p in moved.geom] == [(0, 1), (10, 1)] and moved.geometry_from == "r" and moved.class_from == "p"


def test_evidence(spark):
    n = 200
    grey = np.full((n, n), 0.7)
    grey[95:106, :] = 0.95
    grey[93:95, :] = grey[106:108, :] = 0.3
    grey[40:42, :] = 0.2
    b = [("s", 0, 0.0, 0.0, 200.0, 200.0, n, n, grey.ravel().tolist(), grey.ravel().tolist())]
    blocks = spark.createDataFrame(b, "sheet string, block int, xmin double, ymin double, xmax double, ymax double, width int, height int, grey array<double>, bright array<double>")
    e = [("road", "s", [(20.0, 101.0), (180.0, 101.0)]), ("dark", "s", [(20.0, 160.0), (180.0, 160.0)]), ("none", "s", [(20.0, 30.0), (180.0, 30.0)]), ("short", "s", [(20.0, 101.0), (30.0, 101.0)])]
    got = {r.edge_id: r for r in evidence.score(spark.createDataFrame(e, f"edge_id string, sheet string, geom {LINE}"), blocks).collect()}
    assert (got["road"].present, got["road"].confidence, got["road"].hist_class) == ("present", "high", "major_double_casing")
    assert (got["dark"].present, got["dark"].confidence) == ("present", "low") and got["none"].present == "absent" and got["short"].confidence == "low"
    ink = evidence.ink_mask(blocks)
    assert ink.count() == 64


def test_disaggregation(spark):
    cells = spark.createDataFrame([("a", "p", 0.0), ("b", "p", 150.0), ("c", "p", 450.0), ("d", "q", 1.0)], "cell string, place string, road_m double")
    got = {r.cell: r.population for r in surface.disaggregate(cells, spark.createDataFrame([("p", 1000.0)], "place string, population double")).collect()}
    assert got == pytest.approx({"a": 50 / 750 * 1000, "b": 200 / 750 * 1000, "c": 500 / 750 * 1000, "d": 0.0})


def test_series_and_keys(spark):
    wide = spark.createDataFrame([("a", "1", ""), ("b", " 3 ", "4")], "unit string, y1880 string, y1890 string")
    long = surface.long_series(wide, ["unit"])
    assert {tuple(r) for r in long.collect()} == {("a", 1880, 1.0), ("a", 1890, None), ("b", 1880, 3.0), ("b", 1890, 4.0)}
    keys = spark.createDataFrame([("a",), ("z",)], "unit string")
    assert {tuple(r) for r in surface.population_at(long, keys, 1890).collect()} == {("a", 0.0), ("z", None)}
    with pytest.raises(Exception, match="key repeats"):
        surface.unique_or_raise(wide.union(wide), ["unit"]).collect()


def test_search(spark):
    v = spark.createDataFrame([(1, i, 50.0 + 100 * i, 50.0, 0) for i in range(6)] + [(2, i, 250.0, 50.0 + 100 * i, 1) for i in range(4)], "line int, ord int, x double, y double, grp int")
    cells, links = search.tile_graph(v, 100.0)
    assert cells.count() == 9 and links.count() == 8
    start = spark.createDataFrame([(0,)], "node long")
    goal = spark.createDataFrame([(2 * search.PACK + 3,)], "node long")
    assert search.lower_bound(links, start, goal).count() == 6
    region = lambda d: d.withColumn("region", F.lit("all"))
    got = search.goal_directed(region(links), region(start.withColumnRenamed("node", "cell")), region(goal.select(F.col("node").alias("cell"), F.lit(1).alias("depth"))))
    assert got.where("reached").count() == 1 and got.count() == 6
    one = spark.createDataFrame([(0, 0)], "ix int, iy int")
    found, sizes = search.search_rounds(one, spark.createDataFrame([(5, 0)], "ix int, iy int"), lambda c: c.where("ix < 5").withColumn("side", F.lit("e")), 1, 4)
    assert sizes == [1, 1, 1, 1] and found.count() == 4
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 0.0), (1, 200.0, 0.0)], "k int, x double, y double")
    assert search.spaced(p, "k", ["x"], 150.0).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.csv").write_text("﻿x\n\n\n\n\n\nNamn ;År1890\nB;\nA;7\n", encoding="utf-8")
    got = readers.csv_with_preamble(spark, f"{d}/a.csv").collect()
    assert [(r.source_row, r["Namn"], r["År1890"]) for r in got] == [(0, "B", ""), (1, "A", "7")]
    assert readers.newest(spark, f"{d}/*.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        readers.newest(spark, f"{d}/*.nothing")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert readers.jsonl(spark, f"{d}/l.jsonl", "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        readers.jsonl(spark, f"{d}/l.jsonl", "a int").collect()
    writers.layer(spark.range(3).selectExpr("id", "double(id) xmin", "double(id) xmax", "0D ymin", "1D ymax"), f"{d}/set", "one")
    writers.layer(spark.range(2).selectExpr("id", "double(id) xmin", "double(id) xmax", "0D ymin", "1D ymax"), f"{d}/set", "one", append=True)
    assert readers.layer(spark, f"{d}/set", "one").count() == 5 and readers.layer(spark, f"{d}/set", "two", "id long").count() == 0
    assert readers.parquet(spark, f"{d}/set/one", ["id"], (1.5, 0, 9, 9)).count() == 1
    assert readers.file_table(spark, f"{d}/*.csv", r"^(.)\.csv$", ["letter"]).first().letter == "a"
    writers.provenance(spark, f"{d}/prov", "s", "1", readers.hashes(spark, f"{d}/a.csv"), {"k": 1})
    assert json.loads(spark.read.text(f"{d}/prov").first()[0])["stage"] == "s"
    assert writers.markdown(spark.createDataFrame([(12345, 1.5)], "n long, x double")).endswith("| 12 345 | 1.50 |")
    h = readers.headers(spark.createDataFrame([("a",), ("b",)], "path string"), lambda p: {"n": {"a": 1}[p]}, "n long")
    assert {(r.path, r.status[:5], r.n) for r in h.collect()} == {("a", "ok", 1), ("b", "error", None)}


def test_stream(spark, tmp_path):
    rows = [("t", "A", '{"tile_id": "t", "features": [], "junctions": []}', "2024-01-01 00:00:00")] * 2 + [("u", "C", "x", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "tile_id string, pass string, text string, ts string").write.json(f"{tmp_path}/in")
    q = stream.write(stream.normalised(stream.read(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r.tile_id, r.parsed) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("t", True), ("u", False)}


def test_geopackage_geometries():
    import struct

    from netspark.sources.geopackage import rings

    head = b"GP\0\1" + struct.pack("<i", 3006)
    point = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    assert rings(head + point) == ("Point", [(0, 0, [(3.0, 4.0)])])
    ring = lambda *ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    outer, hole = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]
    polygon = struct.pack("<BII", 1, 3, 2) + ring(*outer) + ring(*hole)
    assert rings(head + polygon) == ("Polygon", [(0, 0, outer), (0, 1, hole)])
    several = struct.pack("<BII", 1, 6, 2) + polygon + struct.pack("<BII", 1, 3, 1) + ring(*outer)
    assert rings(head + several) == ("MultiPolygon", [(0, 0, outer), (0, 1, hole), (1, 0, outer)])
    high = struct.pack(">BII", 0, 1002, 2) + struct.pack(">dddddd", 1, 2, 9, 3, 4, 9)
    with_box = b"GP\0\3" + struct.pack("<i", 3006) + b"\0" * 32 + high
    assert rings(with_box) == ("LineString", [(0, 0, [(1.0, 2.0), (3.0, 4.0)])])


def test_remote_zip_directories(spark, tmp_path):
    import threading
    import zipfile
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from netspark.sources import remote

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.tif", b"x" * 5000)
        z.writestr("two.txt", b"y")
        z.writestr("sub/three.TIF", b"z" * 7)
    raw, asked = (tmp_path / "a.zip").read_bytes(), []

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200 if self.path == "/a.zip" else 404)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()

        def do_GET(self):
            a, z = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            asked.append(z - a + 1)
            self.send_response(206)
            self.end_headers()
            self.wfile.write(raw[a : z + 1])

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rows = remote.zip_members(spark.createDataFrame([(f"{url}/a.zip",), (f"{url}/none.zip",)], "url string")).collect()
    server.shutdown()
    assert {(r.member, r.size) for r in rows if r.status == "ok"} == {("one.tif", 5000), ("sub/three.TIF", 7)}
    assert [r.status[:6] for r in rows if r.status != "ok"] == ["error:"] and sum(asked) < 3 * len(raw)


def test_resampled_windows(spark):
    from netspark.sources import raster

    ramp = [float(c) for _ in range(20) for c in range(0, 200, 10)]
    blocks = spark.createDataFrame([("s", 0, 0, 0, 20, 20, ramp)], "sheet string, block int, row0 int, col0 int, width int, height int, r array<double>")
    wanted = spark.createDataFrame([(1, "s", 4, 4, 12, 12, 6, 6), (2, "s", 4, 4, 12, 12, 24, 24)], "window int, sheet string, col int, row int, w int, h int, out_w int, out_h int")
    got = {r.window: np.array(r.r).reshape(r.height, r.width) for r in raster.windows(wanted, blocks, ("r",)).collect()}
    assert abs(got[1][3, 1:5] - (45 + 20 * np.arange(1, 5))).max() <= 1 and abs(got[2][9, 6:18] - (40 + 10 * (np.arange(6, 18) - 0.5) / 2)).max() <= 2
    edge = raster.windows(wanted.selectExpr("window", "sheet", "-3 as col", "row", "w", "h", "w as out_w", "h as out_h").limit(1), blocks, ("r",)).first()
    assert np.array(edge.r).reshape(12, 12)[0, :5].tolist() == [255, 255, 255, 0, 10]


def test_sheet_footprint(spark):
    from netspark.functions import sheets

    one = spark.createDataFrame([("7C 9b",)], "sheet string").select(*sheets.sheet_box("sheet")).select(sheets.footprint().alias("p")).first().p[0]
    assert [round(v) for v in (min(p.x for p in one), min(p.y for p in one), max(p.x for p in one), max(p.y for p in one))] == [352473, 6441007, 357529, 6446063]
    with pytest.raises(Exception, match="does not match"):
        spark.createDataFrame([("7C9b",)], "sheet string").select(*sheets.sheet_box("sheet")).collect()
    lat, lon = np.radians([55.5, 61.0, 68.9]), np.radians([11.1, 15.0, 23.9])
    for system in (sheets.SHEETS, sheets.WORKING):
        back = sheets.from_grid(*sheets.to_grid(lat, lon, system), system)
        assert np.allclose(back, (lat, lon), atol=1e-11)


def test_strict_parsing_and_lookups_fail_loudly(spark):
    from netspark.functions import scalar as S
    from netspark.operators import spatial

    one = spark.createDataFrame([("cor_1", "x1", 1, 2)], "a string, b string, u int, v int")
    for bad in (lambda: one.select(*S.parsed("a", r"cor_(\d+)_(\d+)", "int", "int")).collect(), lambda: one.select(S.strict_number("b")).collect(), lambda: spatial.coordinates(one, spark.createDataFrame([(1, 0.0, 0.0)], "node int, x double, y double")).collect()):
        with pytest.raises(Exception):
            bad()
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.markdown(spark.range(5), 3)
    assert "<td>4</td>" in writers.report("t", [("a", "text <b>"), ("b", spark.range(5))]) and "&lt;b&gt;" in writers.report("t", [("a", "text <b>")])
    png = writers.grid_png(spark.createDataFrame([(0, 0, 0.0), (2, 1, 1.0)], "cx long, cy long, v double"), "v")
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == b"\0\0\0\3\0\0\0\2"


def test_goal_directed_search_on_a_grid(spark):
    """Against a plain best-first search over one region with shared reads."""
    import heapq
    import random

    rng = random.Random(3)
    cells = {(x, y) for x in range(12) for y in range(12) if rng.random() < 0.8} | {(0, 0), (11, 11), (11, 0)}
    links = [(a, b) for a in cells for b in ((a[0] + 1, a[1]), (a[0], a[1] + 1)) if b in cells]
    code = lambda c: c[0] * search.PACK + c[1]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    goals, read, got = [(1, (11, 0)), (2, (11, 11)), (3, (5, 5)), (4, (30, 30))], {(0, 0)} & near.keys(), set()
    far = lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]))
    for _, goal in goals:
        if goal not in read:
            ring = min((far(c, goal) for c in read), default=0)
            best = {c: 0 for c in read if far(c, goal) <= ring + 3}
            heap = [(far(c, goal), 0, code(c), c) for c in best]
            heapq.heapify(heap)
            done = set()
            while heap and goal not in read:
                f, g, _, c = heapq.heappop(heap)
                if best[c] < g:
                    continue
                done.add(c)
                read.add(c)
                for d in near.get(c, ()):
                    if g + 1 < best.get(d, 999):
                        best[d] = g + 1
                        heapq.heappush(heap, (g + 1 + far(d, goal), g + 1, code(d), d))
        if goal in read:
            got.add(goal)
    df = spark.createDataFrame([("r", code(a), code(b)) for a, b in links], "region string, u long, v long")
    start = spark.createDataFrame([("r", 0)], "region string, cell long")
    wanted = spark.createDataFrame([("r", code(c), d) for d, c in goals], "region string, cell long, depth long")
    rows = search.goal_directed(df, start, wanted).collect()
    assert {r.cell for r in rows} == {code(c) for c in read} and {r.cell for r in rows if r.reached} == {code(c) for c in got}


def test_many_goals_are_looked_for_in_growing_squares(spark):
    import random

    rng = random.Random(5)
    cells = list({(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(60)})
    goals = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(50)] + [(290, 290)]
    want = sorted((min(max(abs(x - a), abs(y - b)) for a, b in goals), x, y) for x, y in cells)
    f, g = spark.createDataFrame(cells, "ix long, iy long"), spark.createDataFrame(goals, "ix long, iy long")
    for k in (5, 60):
        for most in (10, 1000):
            assert [(r.dist, r.ix, r.iy) for r in search.choose(f, g, k, most).collect()] == want[:k]
