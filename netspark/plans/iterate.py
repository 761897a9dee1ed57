"""Lineage cuts for iterative plans: files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's ``spark.checkpoint.dir``; only on one machine (``local``) is a temporary folder set."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its rows in checkpoint files, so a lost executor costs no earlier round."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (without regard to case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name
