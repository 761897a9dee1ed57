"""Population surfaces: grid cells, road length per cell, disaggregation, time series, validity in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netspark.plans.iterate import free


def grid_cells(bounds: DataFrame, size: float = 250.0) -> DataFrame:
    """Centres of the cells of boxes (xmin, ymin, xmax, ymax): cx, cy, x, y."""
    first, last = (lambda c: F.floor(F.col(c) / size).cast("long")), (lambda c: (F.ceil(F.col(c) / size) - 1).cast("long"))
    c = bounds.withColumn("cx", F.explode(F.sequence(first("xmin"), F.greatest(first("xmin"), last("xmax")))))
    c = c.withColumn("cy", F.explode(F.sequence(first("ymin"), F.greatest(first("ymin"), last("ymax")))))
    return c.select("cx", "cy").distinct().withColumns({"x": (F.col("cx") + 0.5) * size, "y": (F.col("cy") + 0.5) * size})


def road_length(segments: DataFrame, size: float = 250.0) -> DataFrame:
    """Length per cell of segments (x1, y1, x2, y2); each counts where its middle lies."""
    mid = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / size).cast("long")
    return segments.groupBy(mid("x1", "x2").alias("cx"), mid("y1", "y2").alias("cy")).agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("road_m"))


def disaggregate(cells: DataFrame, totals: DataFrame, key: str = "place", floor: float = 50.0) -> DataFrame:
    """``population`` of cells (key, road_m): the place's total by ``road_m + floor``; 0 where the total is missing.

    Weights are summed with map-side combine and joined back, so a place with very many cells is no single task.
    """
    weight, every, total = (free(cells, n) for n in ("weight", "weights", "total"))
    w = cells.withColumn(weight, F.coalesce("road_m", F.lit(0.0)) + floor)
    share = w.groupBy(key).agg(F.sum(weight).alias(every)).join(totals.select(key, F.col("population").alias(total)), key, "left")
    out = w.join(share, key, "left")
    return out.withColumn("population", F.coalesce(F.col(total) * F.col(weight) / F.col(every), F.lit(0.0))).drop(weight, every, total)


def long_series(wide: DataFrame, keys: list[str], prefix: str = "y") -> DataFrame:
    """Year columns (``<prefix>1890`` ...) as rows: keys, year, value; empty text is null."""
    years = [c for c in wide.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    out = wide.unpivot(keys, years, "year", "value")
    value = F.nullif(F.trim(F.col("value").cast("string")), F.lit(""))
    return out.select(*keys, F.substring("year", len(prefix) + 1, 9).cast("int").alias("year"), value.cast("double").alias("value"))


def valid_at(rows: DataFrame, year: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows whose closed interval holds the year."""
    return rows.where((F.col(start) <= year) & (F.col(end) >= year))


def sentinels(start: str = "start", end: str = "end") -> list[Column]:
    """Flags for an open beginning (0) and an open end (9999)."""
    return [(F.col(start) == 0).alias("open_start"), (F.col(end) == 9999).alias("open_end")]


def population_at(series: DataFrame, keys: DataFrame, year: int, key: str = "unit") -> DataFrame:
    """Total per requested key in a year; 0 where all values are missing, null where the key is."""
    total = series.where(F.col("year") == year).groupBy(key).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("population"))
    return keys.select(key).join(total, key, "left")


def joined_ids(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct numbers of a key as sorted text, ``;`` between them."""
    ids = F.array_sort(F.collect_set(F.col(value).cast("long")))
    return rows.groupBy(key).agg(F.concat_ws(";", F.transform(ids, lambda x: x.cast("string"))).alias("ids"))


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    k = free(rows, "nth")
    return rows.withColumn(k, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(k) == 1).drop(k)


def unique_or_raise(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``; the query fails if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*keys))
    name = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    return rows.withColumn(keys[0], F.when(n > 1, F.raise_error(F.concat(F.lit("key repeats: "), name))).otherwise(F.col(keys[0])))
