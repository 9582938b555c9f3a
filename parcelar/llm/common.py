"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    A cluster names the shared folder in ``spark.checkpoint.dir``.  Only where that setting is
    absent and the session runs on one machine is a temporary folder used instead; elsewhere the
    executors couldn't see one, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelar-checkpoint-"))


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches of Python stages by their bytes, unless the session has a bound of its own.

    The usual bound is a number of rows, which long texts make hundreds of megabytes.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def give_back() -> None:
    """Return freed memory to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only the C library of GNU has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel of a Python stage, whose worker waits for its next task without the memory of this one."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return wrapped


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two 64-bit keys that rows with the same id and text share, null ids and texts included."""
    return [
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit("second"), F.col(text), F.col(doc_id)).alias("k2"),
    ]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
