"""Sinks: layers of a dataset folder, matrices, provenance, reports."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def layer(df: DataFrame, folder: str, name: str, append: bool = False) -> None:
    """One table per layer: replacing one leaves the others alone."""
    df.write.mode("append" if append else "overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def wide_matrix(od: DataFrame, places: list[str]) -> DataFrame:
    """Origin rows by destination columns; the places are the caller's bounded list."""
    return od.groupBy("origin").pivot("destination", places).agg(F.first("minutes"))


def provenance(spark: SparkSession, path: str, stage: str, version: str, inputs: DataFrame, params: dict) -> None:
    """A JSON sidecar: stage, version, SHA-256 of every input (path, sha256), parameters, UTC time."""
    now = datetime.now(timezone.utc).isoformat()
    body = inputs.agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "sha256")))).alias("inputs"))
    text = F.to_json(F.struct(F.lit(stage).alias("stage"), F.lit(version).alias("version"), "inputs", F.lit(json.dumps(params, sort_keys=True)).alias("params"), F.lit(now).alias("created")))
    body.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small result table as Markdown, thousands set apart; a table of more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a table of more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:,}".replace(",", " ") if isinstance(v, int) and not isinstance(v, bool) else f"{v:,.2f}".replace(",", " ") if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def report(title: str, sections: list[tuple[str, str | DataFrame]], limit: int = 200) -> str:
    """An HTML page of headed texts and small tables."""
    from html import escape

    out = [f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for head, body in sections:
        out.append(f"<h2>{escape(head)}</h2>")
        if isinstance(body, str):
            out.append(f"<p>{escape(body)}</p>")
            continue
        rows = [line.strip("| ").split(" | ") for line in markdown(body, limit).split("\n")]
        cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in row) + "</tr>"
        out.append("<table>" + cells("th", rows[0]) + "".join(cells("td", r) for r in rows[2:]) + "</table>")
    return "\n".join(out)


def grid_png(cells: DataFrame, value: str, most: int = 4_000_000) -> bytes:
    """Cells (cx, cy, value from 0 to 1, null: white) as a grey picture, north up, dark for high; at most ``most`` pixels."""
    import struct
    import zlib

    import numpy as np

    x1, y1, x2, y2 = cells.agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy")).first()
    wide, high = x2 - x1 + 1, y2 - y1 + 1
    if wide * high > most:
        raise ValueError(f"{wide} x {high} cells are more than {most}")
    picture = np.full((high, wide), 255, np.uint8)
    seen = cells.where(F.col(value).isNotNull()).select((F.lit(y2) - F.col("cy")).alias("r"), (F.col("cx") - F.lit(x1)).alias("c"), F.round(230 * (1 - F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)))).cast("int").alias("g"))
    t = seen.groupBy("r", "c").agg(F.min("g").alias("g")).toPandas()  # a row a pixel
    picture[t["r"].astype(int), t["c"].astype(int)] = t["g"]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in picture)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
