"""Map sheets: the grid of sheet ids, and the projections between it and the working system.

Both systems are Gauss-Krüger projections; the sheet grid's ellipsoid is carried onto the working one by a
seven-parameter transformation.  The constants are the published ones of the national mapping authority.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netspark.functions.scalar import parsed

# ---- fixed values: ellipsoids, projections, datum shift (metres, seconds of arc, parts per million)

BESSEL = (6377397.155, 1 / 299.1528128)
GRS80 = (6378137.0, 1 / 298.257222101)
SHEETS = {"ellipsoid": BESSEL, "meridian": 15 + 48 / 60 + 29.8 / 3600, "scale": 1.0, "false_east": 1_500_000.0}
WORKING = {"ellipsoid": GRS80, "meridian": 15.0, "scale": 0.9996, "false_east": 500_000.0}
SHIFT = (414.0978567149, 41.3381489658, 603.0627177516, -0.8550434314, 2.1413465185, -7.0227209516, 0.0)

SHEET_PATTERN = r"(\d+)([A-Z]) (\d)([a-j])"
ORIGIN_NORTH, ORIGIN_EAST, SQUARE, SHEET = 6_050_000, 1_200_000, 50_000, 5_000


def sheet_box(sheet: str) -> list[Column]:
    """xmin, ymin, xmax, ymax of a sheet ("7C 9b") on the sheet grid; another text fails the query.

    Squares of 50 km count north from ORIGIN_NORTH and, by letter, east from ORIGIN_EAST; their sheets of 5 km are 0 to 9
    from the south and a to j from the west.
    """
    row, letter, up, across = parsed(sheet, SHEET_PATTERN, "int", "string", "int", "string")
    north = ORIGIN_NORTH + SQUARE * row + SHEET * up
    east = ORIGIN_EAST + SQUARE * (F.ascii(letter) - ord("A")) + SHEET * (F.ascii(across) - ord("a"))
    return [c.cast("double").alias(n) for c, n in ((east, "xmin"), (north, "ymin"), (east + SHEET, "xmax"), (north + SHEET, "ymax"))]


def _series(f: float) -> tuple:
    """Third flattening, meridian radius factor and series coefficients of the Gauss-Krüger projection, to its fourth power."""
    n = f / (2 - f)
    mean = (1 + n**2 / 4 + n**4 / 64) / (1 + n)
    forth = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    back = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    return n, mean, forth, back


def to_grid(lat: np.ndarray, lon: np.ndarray, system: dict) -> tuple[np.ndarray, np.ndarray]:
    """Easting and northing of geographic coordinates (radians)."""
    a, f = system["ellipsoid"]
    _, mean, forth, _ = _series(f)
    e = math.sqrt(f * (2 - f))
    dl = lon - math.radians(system["meridian"])
    conformal = np.sinh(np.arctanh(np.sin(lat)) - e * np.arctanh(e * np.sin(lat)))
    xi, eta = np.arctan2(conformal, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(conformal, np.cos(dl)))
    x, y = xi.copy(), eta.copy()
    for k, c in enumerate(forth, 1):
        x += c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        y += c * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    r = system["scale"] * mean * a
    return system["false_east"] + r * y, r * x


def from_grid(east: np.ndarray, north: np.ndarray, system: dict) -> tuple[np.ndarray, np.ndarray]:
    """Geographic coordinates (radians) of easting and northing."""
    a, f = system["ellipsoid"]
    _, mean, _, back = _series(f)
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    r = system["scale"] * mean * a
    xi, eta = np.asarray(north, float) / r, (np.asarray(east, float) - system["false_east"]) / r
    x, y = xi.copy(), eta.copy()
    for k, c in enumerate(back, 1):
        x -= c * np.sin(2 * k * xi) * np.cosh(2 * k * eta)
        y -= c * np.cos(2 * k * xi) * np.sinh(2 * k * eta)
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    lat = chi
    for _ in range(8):  # the conformal latitude's inverse converges by e squared a step
        lat = np.arcsin(np.tanh(np.arctanh(np.sin(chi)) + e * np.arctanh(e * np.sin(lat))))
    return lat, math.radians(system["meridian"]) + np.arctan2(np.sinh(y), np.cos(x))


def _cartesian(lat, lon, ellipsoid):
    a, f = ellipsoid
    e2 = f * (2 - f)
    n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return n * np.cos(lat) * np.cos(lon), n * np.cos(lat) * np.sin(lon), n * (1 - e2) * np.sin(lat)


def _geographic(x, y, z, ellipsoid):
    a, f = ellipsoid
    e2 = f * (2 - f)
    p, lat = np.hypot(x, y), np.arctan2(z, np.hypot(x, y) * (1 - e2))
    for _ in range(8):
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e2 * n * np.sin(lat), p)
    return lat, np.arctan2(y, x)


def sheet_to_working(east, north) -> tuple[np.ndarray, np.ndarray]:
    """Points of the sheet grid in the working system (position vector rotation, height 0)."""
    x, y, z = _cartesian(*from_grid(np.asarray(east, float), np.asarray(north, float), SHEETS), BESSEL)
    tx, ty, tz, *turns, ppm = SHIFT
    rx, ry, rz = (math.radians(t / 3600) for t in turns)
    s = 1 + ppm * 1e-6
    moved = tx + s * (x - rz * y + ry * z), ty + s * (rz * x + y - rx * z), tz + s * (-ry * x + rx * y + z)
    return to_grid(*_geographic(*moved, GRS80), WORKING)


@F.pandas_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def working_point(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    """A point of the sheet grid in the working system."""
    x, y = sheet_to_working(east.to_numpy(), north.to_numpy())
    return pd.DataFrame({"x": x, "y": y})


def footprint(box: list[str] = ["xmin", "ymin", "xmax", "ymax"]) -> Column:  # noqa: B006
    """The ring of a sheet's box (columns on the sheet grid) in the working system, as a polygon."""
    x1, y1, x2, y2 = map(F.col, box)
    corners = [working_point(x, y) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))]
    return F.array(F.array(*corners, corners[0]))
