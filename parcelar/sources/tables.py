"""Sources and sinks of experiments."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RESULTS = "id string, n int, k int, heuristic string, f double, time_s double, last_gen int"
FOLDERS = ("Progress", "Plots", "Partitions", "Parameters")


def read_instances(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` written under ``path``; files that can't be read are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    return reader.parquet(f"{path}/nodes"), reader.parquet(f"{path}/edges")


def write_instances(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("append").partitionBy("instance").parquet(f"{path}/nodes")
    edges.write.mode("append").partitionBy("instance").parquet(f"{path}/edges")


def pickled_instance(graph, instance: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of ``nodes`` and ``edges`` for a graph object with ``vs`` (x, name) and ``get_edgelist``."""
    nodes = [(instance, i, str(v["name"]), [float(a) for a in v["x"]]) for i, v in enumerate(graph.vs)]
    edges = sorted((min(u, v), max(u, v)) for u, v in graph.get_edgelist())
    return nodes, [(instance, i, u, v) for i, (u, v) in enumerate(edges)]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Long results, or an empty table where there are none yet."""
    try:
        return spark.read.schema(RESULTS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULTS)


def append_results(results: DataFrame, path: str) -> None:
    results.select(*(c.split()[0] for c in RESULTS.split(", "))).write.mode("append").parquet(path)


def write_results_csv(wide: DataFrame, path: str) -> None:
    """The wide table as one CSV file with a header; a row per execution."""
    wide.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Long results of a wide CSV table as :func:`write_results_csv` writes it; an empty table where there is none."""
    try:
        wide = spark.read.option("header", True).csv(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULTS)
    names = [c.removesuffix("__f") for c in wide.columns if c.endswith("__f")]
    if not names:
        return spark.createDataFrame([], RESULTS)

    def value(name: str, metric: str, kind: str) -> Column:
        column = f"{name}__{metric}"
        return (F.col(f"`{column}`") if column in wide.columns else F.lit(None)).cast(kind)

    runs = [
        F.struct(F.lit(h).alias("heuristic"), value(h, "f", "double").alias("f"), value(h, "time", "double").alias("time_s"), value(h, "last_gen", "int").alias("last_gen"))
        for h in names
    ]
    rows = wide.select(F.col("ID").alias("id"), F.col("N").cast("int").alias("n"), F.col("K").cast("int").alias("k"), F.explode(F.array(*runs)).alias("r"))
    return rows.select("id", "n", "k", "r.*").where("f IS NOT NULL")


def partition_json(partition: DataFrame) -> DataFrame:
    """One row per run: run_id and the regions as JSON text, region number to node names.

    ``partition`` has run_id, region and names (array of strings).
    """
    regions = F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "names"))))
    return partition.groupBy("run_id").agg(F.to_json(regions).alias("value"))


def write_partitions(partition: DataFrame, path: str) -> None:
    """JSON text of each run, in folders by heuristic; ``partition`` has heuristic, run_id, region, names."""
    regions = F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "names"))))
    rows = partition.groupBy("heuristic", "run_id").agg(F.to_json(regions).alias("regions"))
    rows.select("heuristic", F.to_json(F.struct("run_id", "regions")).alias("value")).write.mode("append").partitionBy("heuristic").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where(F.length("id") > 0)


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col("id").alias("value")).write.mode("overwrite").text(path)


def write_config(spark: SparkSession, config: dict, path: str) -> None:
    """One JSON document, through Spark's own writers so that any file system does."""
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def folders(output: str | None, data: str) -> dict[str, str]:
    """Folders of an experiment; the default output is ``Results`` beside the data."""
    top = output or f"{data.rstrip('/')}/Results"
    return {"output": top} | {name: f"{top}/{name}" for name in FOLDERS}
