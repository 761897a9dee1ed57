"""Array geometry: expressions over ``ARRAY<STRUCT<x, y>>`` columns and numpy kernels for what SQL can't say.

A line is an array of points, a polygon an array of rings (outer ring first), all planar metres.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = "array<struct<x:double,y:double>>"
LINES = f"array<{LINE}>"
_POINT_T = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE_T = T.ArrayType(_POINT_T)
_LINES_T = T.ArrayType(LINE_T)


def point(x, y) -> Column:
    return F.struct(F.col(x) if isinstance(x, str) else x, F.col(y) if isinstance(y, str) else y)


def steps(line) -> Column:
    """Consecutive point pairs ``(a, b)`` of a line."""
    g = F.col(line) if isinstance(line, str) else line
    n = F.greatest(F.size(g) - 1, F.lit(0))
    return F.zip_with(F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length(line) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda s, p: s + F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]))


def start(line) -> Column:
    return F.element_at(F.col(line) if isinstance(line, str) else line, 1)


def end(line) -> Column:
    return F.element_at(F.col(line) if isinstance(line, str) else line, -1)


def bounds(line) -> list[Column]:
    """xmin, ymin, xmax, ymax as named columns."""
    g = F.col(line) if isinstance(line, str) else line
    pick = lambda k: F.transform(g, lambda p: p[k])
    return [F.array_min(pick("x")).alias("xmin"), F.array_min(pick("y")).alias("ymin"), F.array_max(pick("x")).alias("xmax"), F.array_max(pick("y")).alias("ymax")]


def ring_area(ring: Column) -> Column:
    """Shoelace area, without sign."""
    return F.abs(F.aggregate(steps(ring), F.lit(0.0), lambda s, p: s + p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"])) / 2


def area(polygon) -> Column:
    """Area of a polygon: outer ring less holes."""
    rings = F.transform(polygon, ring_area)
    return 2 * F.element_at(rings, 1) - F.aggregate(rings, F.lit(0.0), lambda s, a: s + a)


def valid_polygon(polygon) -> Column:
    """Whether every ring closes, has four points or more and an area (crossings of rings are not looked for)."""
    ring = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & (ring_area(r) > 0)
    return F.coalesce((F.size(polygon) > 0) & F.forall(polygon, ring), F.lit(False))


def midpoint(line: str) -> Column:
    """The point half way along a line."""
    return point_at(line, length(line) / 2)


def point_at(line: str, at: Column) -> Column:
    """The point at a distance along a line."""
    walk = F.aggregate(
        steps(line),
        F.struct(F.lit(0.0).alias("s"), start(line)["x"].alias("x"), start(line)["y"].alias("y")),
        lambda acc, p: _step(acc, p, at),
    )
    return F.struct(walk["x"].alias("x"), walk["y"].alias("y"))


def _step(acc: Column, p: Column, at: Column) -> Column:
    dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
    n = F.hypot(dx, dy)
    t = F.when(n == 0, 0.0).otherwise(F.least((at - acc["s"]) / F.when(n == 0, 1.0).otherwise(n), F.lit(1.0)))
    on = at >= acc["s"]
    return F.struct(
        (acc["s"] + n).alias("s"),
        F.when(on, p["a"]["x"] + t * dx).otherwise(acc["x"]).alias("x"),
        F.when(on, p["a"]["y"] + t * dy).otherwise(acc["y"]).alias("y"),
    )


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over all rings (even-odd): the interior, with lower and left boundaries."""

    def crosses(p: Column) -> Column:
        a, b = p["a"], p["b"]
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"])
        return F.when(((a["y"] > y) != (b["y"] > y)) & (x < at), 1).otherwise(0)

    hits = F.aggregate(F.flatten(F.transform(polygon, steps)), F.lit(0), lambda s, p: s + crosses(p))
    return hits % 2 == 1


def point_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment and where the nearest point lies (0 to 1)."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / F.when(square == 0, 1.0).otherwise(square), F.lit(0.0)), F.lit(1.0)))
    return F.hypot(px - x1 - t * dx, py - y1 - t * dy), t


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """``(a, b, c, d, e, f)``: x' = a x + b y + c, y' = d x + e y + f."""
    a, b, c, d, e, f = m
    return a * x + b * y + c, d * x + e * y + f


def polyline(waypoints: str, m: tuple[float, ...]) -> Column:
    """Line from ``ARRAY<ARRAY<DOUBLE>>`` waypoints through an affine transform."""

    def one(p: Column) -> Column:
        x, y = affine(p[0], p[1], m)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.col(waypoints), one)


def segments(lines: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """One row per segment: key, seg, x1, y1, x2, y2, at (distance along the line where it begins).

    The distance is a running sum over a line's segments, so a line costs as much as it has vertices.
    """
    s = lines.select(key, F.monotonically_increasing_id().alias("line_row"), F.col(geom).alias("geom"))
    s = s.select(key, "line_row", F.posexplode(steps("geom")).alias("seg", "s"))
    s = s.select(key, "line_row", "seg", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
    own = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    before = Window.partitionBy("line_row").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("at", F.coalesce(F.sum(own).over(before), F.lit(0.0))).drop("line_row")


# ---- numpy kernels (one line: an (n, 2) array)


def as_array(line) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)


def along(xy: np.ndarray) -> np.ndarray:
    """Distance from the start at every vertex."""
    return np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]) if len(xy) > 1 else np.zeros(len(xy))


def interpolate(xy: np.ndarray, d) -> np.ndarray:
    """Points at distances ``d`` along a line."""
    s = along(xy)
    return np.stack([np.interp(d, s, xy[:, 0]), np.interp(d, s, xy[:, 1])], -1)


def project(xy: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """Distance along the line of the point nearest to ``p``, and its distance from ``p``."""
    a, v = xy[:-1], np.diff(xy, axis=0)
    square = (v**2).sum(1)
    t = np.clip(((p - a) * v).sum(1) / np.where(square == 0, 1, square), 0, 1)
    near = a + t[:, None] * v
    d = np.hypot(*(near - p).T)
    k = int(np.argmin(d))
    return float(along(xy)[k] + t[k] * np.sqrt(square[k])), float(d[k])


def substring(xy: np.ndarray, a: float, b: float) -> np.ndarray:
    """The part of a line between two distances along it."""
    s = along(xy)
    mid = xy[(s > a) & (s < b)]
    return np.concatenate([interpolate(xy, [a]), mid, interpolate(xy, [b])])


def split_at(xy: np.ndarray, cuts: list[float], least: float = 0.01) -> list[np.ndarray]:
    """Pieces between the cuts; those of at most ``least`` metres vanish."""
    total = along(xy)[-1]
    marks = sorted({0.0, total, *(float(c) for c in cuts if 0 < c < total)})
    return [substring(xy, a, b) for a, b in zip(marks, marks[1:]) if b - a > least]


def pieces(xy: np.ndarray, n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of pieces ``first`` to ``last`` (excluded) of ``n`` equal ones, one after the other, and how many each has."""
    s = along(xy)
    marks = s[-1] * np.arange(first, last + 1) / n
    ends = interpolate(xy, marks)
    a = np.searchsorted(s, marks[:-1], "right")  # the line's own vertices strictly between two marks
    inner = np.maximum(np.searchsorted(s, marks[1:], "left") - a, 0)
    size = inner + 2
    at = np.cumsum(size) - size
    out = np.empty((int(size.sum()), 2))
    out[at], out[at + size - 1] = ends[:-1], ends[1:]
    nth = np.arange(inner.sum()) - np.repeat(np.cumsum(inner) - inner, inner)
    out[np.repeat(at + 1, inner) + nth] = xy[np.repeat(a, inner) + nth]
    return out, size


def n_pieces(xy: np.ndarray, most: float) -> int:
    return max(1, int(np.ceil(along(xy)[-1] / most)))


def equal_pieces(xy: np.ndarray, most: float = 250.0) -> list[np.ndarray]:
    """Equal pieces of at most ``most`` metres."""
    n = n_pieces(xy, most)
    points, size = pieces(xy, n, 0, n)
    return np.split(points, np.cumsum(size)[:-1])


def is_simple(xy: np.ndarray) -> bool:
    """Whether no two parts of a line meet, other than neighbours at their vertex and a ring's ends."""
    keep = np.concatenate([[True], (np.diff(xy, axis=0) != 0).any(1)])
    p = xy[keep]
    n = len(p) - 1
    if n < 1:
        return True
    a, b = p[:-1], p[1:]
    turn = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
    closed = (p[0] == p[-1]).all()
    for i in range(n):
        if i + 1 < n and turn(a[i], b[i], b[i + 1]) == 0 and ((b[i] - a[i]) * (b[i + 1] - b[i])).sum() < 0:
            return False  # folds back on itself
        j = np.arange(i + 2, n)
        if closed and i == 0:
            j = j[j != n - 1]
        if not len(j):
            continue
        d1, d2 = np.sign(turn(a[i], b[i], a[j])), np.sign(turn(a[i], b[i], b[j]))
        d3, d4 = np.sign(turn(a[j], b[j], a[i])), np.sign(turn(a[j], b[j], b[i]))
        on = lambda o, u, q, s: (s == 0) & (q >= np.minimum(o, u)).all(-1) & (q <= np.maximum(o, u)).all(-1)
        touch = on(a[i], b[i], a[j], d1) | on(a[i], b[i], b[j], d2) | on(a[j], b[j], a[i], d3) | on(a[j], b[j], b[i], d4)
        if ((d1 * d2 < 0) & (d3 * d4 < 0) | touch).any():
            return False
    return True


def crosses(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lines share a point."""
    p, r = a[:-1, None], np.diff(a, axis=0)[:, None]
    q, s = b[None, :-1], np.diff(b, axis=0)[None]
    turn = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    d1, d2, d3, d4 = turn(s, p - q), turn(s, p + r - q), turn(r, q - p), turn(r, q + s - p)
    on = lambda d, o, v, x: (d == 0) & (np.minimum(o, o + v) <= x).all(-1) & (x <= np.maximum(o, o + v)).all(-1)
    touch = on(d1, q, s, p) | on(d2, q, s, p + r) | on(d3, p, r, q) | on(d4, p, r, q + s)
    return bool(((np.sign(d1) * np.sign(d2) < 0) & (np.sign(d3) * np.sign(d4) < 0) | touch).any())


def polygons_meet(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    """Whether two polygons share a point: a ring crosses a ring, or one holds a vertex of the other."""
    return any(crosses(x, y) for x in a for y in b) or _in(a[0][0], b) or _in(b[0][0], a)


def nearest_points(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance of two lines and the points of each where it is reached (0 and one shared point where they cross)."""
    best = (np.inf, a[0], b[0])
    if crosses(a, b):
        for i in range(len(a) - 1):
            for j in range(len(b) - 1):
                r, s = a[i + 1] - a[i], b[j + 1] - b[j]
                d = r[0] * s[1] - r[1] * s[0]
                w = b[j] - a[i]
                if d != 0 and 0 <= (t := (w[0] * s[1] - w[1] * s[0]) / d) <= 1 and 0 <= (w[0] * r[1] - w[1] * r[0]) / d <= 1:
                    return 0.0, a[i] + t * r, a[i] + t * r
    for one, other, turned in ((a, b, False), (b, a, True)):
        for p in one:
            at, d = project(other, p)
            if d < best[0]:
                q = interpolate(other, [at])[0]
                best = (d, q, p) if turned else (d, p, q)
    return best


def hausdorff(a: np.ndarray, b: np.ndarray) -> float:
    """Discrete Hausdorff distance: vertices of each to the other line."""
    one = lambda p, q: max(project(q, x)[1] for x in p)
    return max(one(a, b), one(b, a))


def mean_offset(a: np.ndarray, b: np.ndarray, step: float = 1.0) -> float:
    """Mean distance to ``b`` of points every ``step`` metres along ``a``."""
    d = np.linspace(0, along(a)[-1], max(2, int(np.ceil(along(a)[-1] / step)) + 1))
    return float(np.mean([project(b, p)[1] for p in interpolate(a, d)]))


def thin(xy: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Points that lie more than ``least`` from the last kept one."""
    out = [xy[0]]
    for p in xy[1:]:
        if np.hypot(*(p - out[-1])) > least:
            out.append(p)
    return np.array(out)


def clip(xy: np.ndarray, polygon: list[np.ndarray]) -> list[np.ndarray]:
    """Parts of a line inside a polygon (rings; even-odd)."""
    cuts = [0.0]
    s = along(xy)
    for i in range(len(xy) - 1):
        p, r = xy[i], xy[i + 1] - xy[i]
        for ring in polygon:
            q, v = ring[:-1], np.diff(ring, axis=0)
            cross = r[0] * v[:, 1] - r[1] * v[:, 0]
            ok = cross != 0
            w = q[ok] - p
            t = (w[:, 0] * v[ok, 1] - w[:, 1] * v[ok, 0]) / cross[ok]
            u = (w[:, 0] * r[1] - w[:, 1] * r[0]) / cross[ok]
            cuts += list(s[i] + t[(t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)] * (s[i + 1] - s[i]))
    cuts = sorted({*cuts, s[-1]})
    parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1e-9 and _in(interpolate(xy, [(a + b) / 2])[0], polygon)]
    merged: list[list[float]] = []
    for a, b in parts:
        if merged and a - merged[-1][1] < 1e-9:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [substring(xy, a, b) for a, b in merged]


def _in(p: np.ndarray, rings: list[np.ndarray]) -> bool:
    hits = 0
    for r in rings:
        a, b = r[:-1], r[1:]
        up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        x = a[up, 0] + (p[1] - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1])
        hits += int((p[0] < x).sum())
    return hits % 2 == 1


def inner_point(rings: list[np.ndarray]) -> tuple[float, float]:
    """A point inside a polygon: the middle of its widest stretch on the horizontal through its middle."""
    ys = np.unique(np.concatenate([r[:, 1] for r in rings]))
    y = (ys[0] + ys[-1]) / 2
    if y in ys:
        y = (y + ys[np.searchsorted(ys, y) - 1]) / 2
    xs = []
    for r in rings:
        a, b = r[:-1], r[1:]
        up = (a[:, 1] > y) != (b[:, 1] > y)
        xs += list(a[up, 0] + (y - a[up, 1]) * (b[up, 0] - a[up, 0]) / (b[up, 1] - a[up, 1]))
    xs.sort()
    pairs = list(zip(xs[::2], xs[1::2]))
    lo, hi = max(pairs, key=lambda p: p[1] - p[0])
    return float((lo + hi) / 2), float(y)


def _points(xy: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in xy]


@F.pandas_udf(_LINES_T)
def split_line(geom: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([[_points(p) for p in split_at(as_array(g), [] if c is None else list(c))] for g, c in zip(geom, cuts)])


def split_equal(lines: DataFrame, most: float, geom: str = "geom", at_once: int = 1 << 15) -> DataFrame:
    """A row for each equal piece of at most ``most`` metres: the columns of ``lines`` with the piece as ``geom``, and
    ``piece`` and ``length_m``.  A batch holds ``at_once`` pieces and the points of one line more at most, however long the lines are.
    """
    schema = T.StructType([*(T.StructField(f.name, LINE_T if f.name == geom else f.dataType) for f in lines.schema), T.StructField("piece", T.IntegerType()), T.StructField("length_m", T.DoubleType())])
    other = [c for c in lines.columns if c != geom]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            course, taken, got, kept = b.column(geom), [], [], 0
            for i in range(b.num_rows):
                if not course[i].is_valid or not len(course[i]):
                    continue
                p = course[i].values
                xy = np.stack([p.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1).astype(float)
                n, first = n_pieces(xy, most), 0
                while first < n:
                    last = min(n, first + at_once - kept)
                    taken.append(np.full(last - first, i))
                    got.append((*pieces(xy, n, first, last), np.arange(first, last)))
                    kept, first = kept + last - first, last
                    if kept >= at_once:
                        yield batch(b, taken, got)
                        taken, got, kept = [], [], 0
            if kept:
                yield batch(b, taken, got)

    def batch(b: pa.RecordBatch, taken: list, got: list) -> pa.RecordBatch:
        xy = np.concatenate([g[0] for g in got])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([g[1] for g in got]))]).astype(np.int32)
        lines_of = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))
        own = np.append(np.hypot(*np.diff(xy, axis=0).T), 0.0)
        own[ends[1:] - 1] = 0.0  # from a piece to the next
        rows = b.select(other).take(pa.array(np.concatenate(taken)))
        cols = {**{c: rows.column(c) for c in other}, geom: lines_of, "piece": pa.array(np.concatenate([g[2] for g in got]), pa.int32()), "length_m": pa.array(np.add.reduceat(own, ends[:-1]))}
        return pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=schema.names)

    return lines.mapInArrow(run, schema)


@F.pandas_udf(_LINES_T)
def clip_line(geom: pd.Series, polygon: pd.Series) -> pd.Series:
    return pd.Series([[_points(p) for p in clip(as_array(g), [as_array(r) for r in rings])] for g, rings in zip(geom, polygon)])


@F.pandas_udf(T.BooleanType())
def simple(geom: pd.Series) -> pd.Series:
    return pd.Series([is_simple(as_array(g)) for g in geom])


@F.pandas_udf(T.StructType([T.StructField("hausdorff", T.DoubleType()), T.StructField("mean", T.DoubleType())]))
def course_offset(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None or y is None else (hausdorff(as_array(x), as_array(y)), mean_offset(as_array(x), as_array(y))) for x, y in zip(a, b)]
    return pd.DataFrame(rows, columns=["hausdorff", "mean"])


@F.pandas_udf(T.BooleanType())
def polygons_intersect(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([polygons_meet([as_array(r) for r in x], [as_array(r) for r in y]) for x, y in zip(a, b)], dtype=bool)


@F.pandas_udf(T.StructType([T.StructField("dist", T.DoubleType()), T.StructField("a", _POINT_T), T.StructField("b", _POINT_T)]))
def closest(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance of two lines and the nearest point of each."""
    rows = [nearest_points(as_array(x), as_array(y)) for x, y in zip(a, b)]
    return pd.DataFrame([(d, *_points(np.array([p, q]))) for d, p, q in rows], columns=["dist", "a", "b"])


def segmentised(geom, step: Column) -> Column:
    """A line with vertices added so that none are further apart than ``step``; its own vertices stay."""
    g = F.col(geom) if isinstance(geom, str) else geom

    def one(p: Column) -> Column:
        dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
        n = F.greatest(F.ceil(F.hypot(dx, dy) / step), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((p["a"]["x"] + dx * i / n).alias("x"), (p["a"]["y"] + dy * i / n).alias("y")))

    return F.when(F.size(g) > 0, F.concat(F.flatten(F.transform(steps(g), one)), F.slice(g, -1, 1))).otherwise(g)


@F.pandas_udf(LINE_T)
def thinned(geom: pd.Series, least: pd.Series) -> pd.Series:
    """A line without the points that lie at most ``least`` from the last one kept."""
    return pd.Series([_points(thin(as_array(g), m)) for g, m in zip(geom, least)])


@F.pandas_udf(_POINT_T)
def representative_point(polygon: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inner_point([as_array(r) for r in p]) for p in polygon], columns=["x", "y"])
