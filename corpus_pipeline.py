"""The corpus pipeline: filter, deduplicate, decontaminate, redact and encode the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.  Side
tables (labels, benchmark) come from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from parcelar.llm import decontamination, jaccard_join, quality, secrets, sentencepiece_codec
from parcelar.llm.common import documents, ensure_checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return jaccard_join.keep_representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secrets.redact_secrets(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_codec.encode_texts(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("SentencePiece encoding", encoding),
]

#: SQL expresses neither the fitted models nor the encoder.  The tests hold each stage, on documents and on edge-case
#: rows, against a chain in plain Python (verdicts of the two fitted models are the operators' own), and run() against it.
ORACLE_SQL = None


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _finished(spark: SparkSession, name: str) -> bool:
    store, path = _path(spark, f"{name}/_SUCCESS")
    return store.exists(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of :func:`run`, once its result has been read."""
    store, path = _path(spark, folder)
    store.delete(path, True)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read again.

    Under a ``folder`` of the caller's name, which stands for these documents, a run that failed goes on behind
    the last stage that was written whole.  A stage's table goes when the next one is written, so the last but one
    stays; :func:`remove` deletes it.  Without a name the folder is new.  No documents give no rows; rows with
    nulls, empty or long texts and repeated rows are treated as the stages' operators state.
    """
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    written = len(STAGES) - 1
    start = next((n + 1 for n in reversed(range(written)) if _finished(spark, f"{folder}/{n}")), 0)
    docs = spark.read.parquet(f"{folder}/{start - 1}") if start else documents(spark, sf_dir)
    for nth in range(start, written):
        STAGES[nth][1](spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{nth}")
        docs = spark.read.parquet(f"{folder}/{nth}")
        if nth:
            remove(spark, f"{folder}/{nth - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
