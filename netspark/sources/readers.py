"""Sources, all through Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Pruned columns; ``bbox`` filters on xmin, ymin, xmax, ymax, which Parquet's statistics see."""
    df = spark.read.parquet(path)
    if bbox:
        x1, y1, x2, y2 = bbox
        df = df.where((F.col("xmin") <= x2) & (F.col("xmax") >= x1) & (F.col("ymin") <= y2) & (F.col("ymax") >= y1))
    return df.select(*columns) if columns else df


def layer(spark: SparkSession, folder: str, name: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A layer of a dataset folder; an absent one is empty if a schema is given."""
    try:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def state(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A state table of JSON lines; empty where there is none yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def csv_text(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """CSV with a header, every column as text."""
    return spark.read.csv(path, schema=schema, header=True, sep=sep, nullValue="\u0000", emptyValue="")


def csv_with_preamble(spark: SparkSession, path: str, skip: int = 6, sep: str = ";") -> DataFrame:
    """CSV whose header follows ``skip`` lines: text columns with trimmed names, and ``source_row`` in file order.

    A byte-order mark goes; empty fields stay empty text.  The file is read whole, one row a file, and cut there.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n").alias("l"))
    head = [c.strip() for c in lines.select(F.element_at("l", skip + 1)).first()[0].split(sep)]
    rows = lines.select(F.posexplode(F.slice("l", skip + 2, 1_000_000_000)).alias("source_row", "line")).where("trim(line) <> ''")
    parsed = F.from_csv("line", ", ".join(f"`c{i}` string" for i in range(len(head))), {"sep": sep, "nullValue": "\u0000", "emptyValue": ""})
    return rows.select("source_row", parsed.alias("r")).select("source_row", *(F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(c) for i, c in enumerate(head)))


def newest(spark: SparkSession, pattern: str) -> str:
    """The last path by name; raises if there is none."""
    try:
        row = spark.read.format("binaryFile").load(pattern).select("path").agg(F.max("path")).first()
    except AnalysisException as e:
        raise FileNotFoundError(pattern) from e
    if row[0] is None:
        raise FileNotFoundError(pattern)
    return row[0]


def file_table(spark: SparkSession, pattern: str, regex: str, names: list[str]) -> DataFrame:
    """Paths with the groups of ``regex`` in the file name as columns; files of other names are left out."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.where(F.col("file").rlike(regex)).select("path", "file", *(F.regexp_extract("file", regex, i + 1).alias(n) for i, n in enumerate(names)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One object a line; unreadable lines fail the read or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct link targets of pages, sorted within each page's key columns."""
    found = F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select(*[c for c in pages.columns if c != html], F.explode(found).alias("link")).distinct()


def headers(rows: DataFrame, read, schema: str, key: str = "path") -> DataFrame:
    """``read(path) -> dict`` for every row; what fails is a row whose status says why (300 characters)."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(",")]

    def run(batches):
        for b in batches:
            out = []
            for path in b[key]:
                try:
                    out.append({key: path, "status": "ok", **read(path)})
                except Exception as e:  # noqa: BLE001
                    out.append({key: path, "status": f"error: {e}"[:300]})
            yield pd.DataFrame(out, columns=[key, "status", *names])

    return rows.select(key).mapInPandas(run, f"{key} string, status string, {schema}")
