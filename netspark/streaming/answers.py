"""An addition beside the batch operators: answers as a stream of files, normalised and kept once per tile and pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netspark.functions import answers as A

SCHEMA = "tile_id string, pass string, text string, ts timestamp"


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def normalised(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each tile and pass once, however often it is delivered within ``late``: object, wrapped, parsed."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["tile_id", "pass"])
    return A.documents(once).withColumn("parsed", F.col("object").isNotNull())


def write(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    w = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def event_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums per event type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
