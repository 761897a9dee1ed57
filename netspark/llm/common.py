"""What the operators of this subpackage share: the shared folder, stored tables, whole texts in Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (``local``) is a temporary folder set; a cluster without
    the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
            root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends at files that outlive executors.

    The files are those of a running application: they are deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def passing(spark: SparkSession, path: str) -> None:
    """Marks files for deletion at the end of the application."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` is called so (names are compared as Spark does, without case)."""
    used = {c.lower() for c in df.columns}
    while base in used:
        base += "_"
    return base


def first_by_hash(rows: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by``, in the order of the hash of ``key``: a bounded sample.

    Only rows whose hash lies in the first ``1.5 n / (rows of that value)`` of all hashes are ranked, so a value that
    most rows have gathers no more rows in one task than any other.  ``by`` must have few values (one count each is
    broadcast).  Null values of ``by`` give no rows.
    """
    size, share = F.broadcast(rows.groupBy(by).agg(F.count("*").alias("n_rows"))), F.xxhash64(key) / float(1 << 64) + 0.5
    some = rows.join(size, by).where(share * F.col("n_rows") < 1.5 * n + 50)
    order = Window.partitionBy(by).orderBy(F.xxhash64(key), key)
    return some.withColumn("k_row", F.row_number().over(order)).where(F.col("k_row") <= n).select(*rows.columns)


def whole_texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty, plus named columns; any other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, so that only few texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
