"""Raster sheets as block tables: bands to grey and bright, windows of a sheet resampled to pictures.

A block is a row: sheet, block, row0, col0 (the sheet's pixel at its corner), width, height and its bands as row-major
arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_bands(blocks: DataFrame) -> DataFrame:
    """``grey`` (least of the bands r, g, b, 0 to 1) and ``bright`` (greatest), null where all three are 0 (no data)."""
    pixel = F.arrays_zip("r", "g", "b")
    known = lambda p: (p["r"] != 0) | (p["g"] != 0) | (p["b"] != 0)
    band = lambda how: F.transform(pixel, lambda p: F.when(known(p), how(p["r"], p["g"], p["b"]) / 255.0))
    return blocks.withColumns({"grey": band(F.least), "bright": band(F.greatest)}).drop("r", "g", "b")


def cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel (a = -1/2)."""
    x = np.abs(x)
    return np.where(x <= 1, (1.5 * x - 2.5) * x**2 + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


def _weights(n_in: int, n_out: int) -> np.ndarray:
    """Resampling matrix: cubic, widened where pixels get fewer; rows sum to 1."""
    scale = n_in / n_out
    wide = max(1.0, scale)
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    w = cubic((np.arange(n_in)[None] - centre[:, None]) / wide)
    return w / w.sum(1, keepdims=True)


def windows(wanted: DataFrame, blocks: DataFrame, bands: tuple[str, ...] = ("r", "g", "b"), fill: float = 255.0) -> DataFrame:
    """``window, width, height`` and every band of windows (window, sheet, col, row, w, h, out_w, out_h) of a sheet.

    Windows may reach beyond the sheet and over missing blocks: ``fill`` stands there.  Blocks meet only the windows that
    they overlap; a window is put together and resampled in one task.
    """
    b = blocks.select("sheet", "row0", "col0", F.col("width").alias("bw"), F.col("height").alias("bh"), *bands)
    meets = (F.col("col0") < F.col("col") + F.col("w")) & (F.col("col0") + F.col("bw") > F.col("col")) & (F.col("row0") < F.col("row") + F.col("h")) & (F.col("row0") + F.col("bh") > F.col("row"))
    both = wanted.join(b, "sheet").where(meets).select(F.col("window").alias("window"), *(F.col(c).alias(c) for c in ("row0", "col0", "bw", "bh", *bands)))

    def run(key, asked: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a in asked.itertuples():
            out = {"window": a.window, "width": a.out_w, "height": a.out_h}
            for band in bands:
                whole = np.full((a.h, a.w), float(fill))
                for p in parts.itertuples():
                    tile = np.asarray(getattr(p, band), float).reshape(p.bh, p.bw)
                    r0, r1 = max(a.row, p.row0), min(a.row + a.h, p.row0 + p.bh)
                    c0, c1 = max(a.col, p.col0), min(a.col + a.w, p.col0 + p.bw)
                    whole[r0 - a.row : r1 - a.row, c0 - a.col : c1 - a.col] = tile[r0 - p.row0 : r1 - p.row0, c0 - p.col0 : c1 - p.col0]
                seen = whole if (a.h, a.w) == (a.out_h, a.out_w) else _weights(a.h, a.out_h) @ whole @ _weights(a.w, a.out_w).T
                out[band] = np.clip(np.rint(seen), 0, 255).ravel().tolist()
            rows.append(out)
        return pd.DataFrame(rows, columns=["window", "width", "height", *bands])

    kind = dict(wanted.dtypes)["window"]
    schema = f"window {kind}, width int, height int, " + ", ".join(f"{x} array<double>" for x in bands)
    return wanted.groupBy("window").cogroup(both.groupBy("window")).applyInPandas(run, schema)


def crops(centres: DataFrame, sheets: DataFrame, blocks: DataFrame, size_m: float = 400.0, pixels: int = 600, **options) -> DataFrame:
    """Square pictures about points (window, sheet, x, y); ``sheets``: sheet, xmin, ymax, metres a pixel (res)."""
    at = centres.join(sheets.select("sheet", "xmin", "ymax", "res"), "sheet")
    n = F.round(size_m / F.col("res")).cast("int")
    first = lambda d: F.round((d - size_m / 2) / F.col("res")).cast("int")
    wanted = at.select("window", "sheet", first(F.col("x") - F.col("xmin")).alias("col"), first(F.col("ymax") - F.col("y")).alias("row"), n.alias("w"), n.alias("h"), F.lit(pixels).alias("out_w"), F.lit(pixels).alias("out_h"))
    return windows(wanted, blocks, **options)
