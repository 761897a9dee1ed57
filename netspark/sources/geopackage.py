"""GeoPackage layers: SQLite files read whole from any store that Spark reads, their geometries as arrays of points.

A file is opened in memory by the task that gets it, so files must fit a task; large layers belong in Parquet.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
_DDL = "path string, kind string, part int, ring int, geom array<struct<x:double,y:double>>, attributes map<string,string>"


def rings(raw: bytes) -> tuple[str, list[tuple[int, int, list[tuple[float, float]]]]]:
    """Kind of a GeoPackage geometry and its point lists as (part, ring, points); z and m are read over."""
    flags = raw[3]
    at = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[flags >> 1 & 7]
    out: list[tuple[int, int, list]] = []

    def read(at: int, part: int) -> tuple[int, int]:
        order = "<" if raw[at] else ">"
        (code,) = struct.unpack_from(order + "I", raw, at + 1)
        extra = code // 1000 if code < 1 << 28 else (code >> 30 & 1) + (code >> 31)
        kind, size = (code % 1000 if code < 1 << 28 else code & 0xFF), 2 + (2 if extra == 3 else min(extra, 1))
        at += 5

        def points(at: int, n: int) -> tuple[list, int]:
            found = struct.iter_unpack(order + "d" * size, raw[at : at + 8 * size * n])
            return [p[:2] for p in found], at + 8 * size * n

        if kind == 1:
            p, at = points(at, 1)
            out.append((part, 0, p))
        elif kind == 2:
            p, at = points(at + 4, *struct.unpack_from(order + "I", raw, at))
            out.append((part, 0, p))
        elif kind == 3:
            (n,), at = struct.unpack_from(order + "I", raw, at), at + 4
            for k in range(n):
                p, at = points(at + 4, *struct.unpack_from(order + "I", raw, at))
                out.append((part, k, p))
        else:
            (n,), at = struct.unpack_from(order + "I", raw, at), at + 4
            for k in range(n):
                _, at = read(at, k)
        return kind, at

    kind, _ = read(at, 0)
    return KINDS[kind], out


def read(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A row for each point list of a layer's features: path, feature (its row number), kind, part, ring, geom, attributes
    (as text).  Features without a geometry give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                (shape,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", [layer]).fetchone()
                found = db.execute(f'SELECT * FROM "{layer}"')  # noqa: S608
                names = [c[0] for c in found.description]
                rows = []
                for number, row in enumerate(found):
                    values = dict(zip(names, row))
                    raw = values.pop(shape)
                    if raw is None:
                        continue
                    kind, lists = rings(raw)
                    about = {k: None if v is None else str(v) for k, v in values.items()}
                    rows += [(path, number, kind, part, ring, [{"x": x, "y": y} for x, y in p], about) for part, ring, p in lists]
                db.close()
                yield pd.DataFrame(rows, columns=["path", "feature", "kind", "part", "ring", "geom", "attributes"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, _DDL.replace("path string,", "path string, feature long,"))


def polygons(rows: DataFrame) -> DataFrame:
    """Rings of ``read`` as polygons: path, feature, part, polygon, attributes."""
    rings_ = F.transform(F.sort_array(F.collect_list(F.struct("ring", "geom"))), lambda r: r["geom"])
    of = rows.where(F.col("kind").isin("Polygon", "MultiPolygon")).groupBy("path", "feature", "part")
    return of.agg(rings_.alias("polygon"), F.any_value("attributes").alias("attributes"))
