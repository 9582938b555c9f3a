"""Checkpoints in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Name the folder for checkpoints: that of ``spark.checkpoint.dir``.

    A temporary folder serves where that is unset on one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelar-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
