"""Instances made from star-schema tables: ``nodes`` and ``edges`` DataFrames.

nodes: instance, node_id INT, name, x ARRAY<DOUBLE>.
edges: instance, edge_id INT (dense, by (u, v)), u INT, v INT with u < v.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(edges: DataFrame) -> DataFrame:
    order = Window.partitionBy("instance").orderBy("u", "v")
    return edges.select(
        "instance", (F.row_number().over(order) - 1).alias("edge_id"), F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v")
    )


def nation_nodes(spark: SparkSession, sf_dir: str, instance: str = "nation_lattice") -> DataFrame:
    customers = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a"), F.count("*").alias("n"))
    nations = _table(spark, sf_dir, "nation")
    return nations.join(customers, nations.n_nationkey == customers.c_nationkey, "left").select(
        F.lit(instance).alias("instance"),
        F.col("n_nationkey").cast("int").alias("node_id"),
        F.col("n_name").alias("name"),
        F.array(F.coalesce("a", F.lit(0.0)), F.coalesce("n", F.lit(0)) * 100.0).alias("x"),
    )


def _rook(cells: DataFrame, right: bool = True, down: bool = True) -> DataFrame:
    """Edges between cells (instance, node_id, row, col) that touch in a row or a column."""
    parts = []
    for dr, dc, wanted in ((0, 1, right), (1, 0, down)):
        if wanted:
            b = cells.select("instance", F.col("node_id").alias("v"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"))
            parts.append(cells.join(b, ["instance", "row", "col"]).select("instance", F.col("node_id").alias("u"), "v"))
    edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _numbered(edges.select("instance", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def nation_lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """25 nations on a 5 x 5 grid."""
    nodes = nation_nodes(spark, sf_dir)
    return nodes, _rook(nodes.withColumn("row", F.expr("node_id div 5").cast("int")).withColumn("col", F.expr("node_id % 5")))


def nation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same nations with the rows of the grid not connected: five components."""
    nodes = nation_nodes(spark, sf_dir, "nation_rows")
    cells = nodes.withColumn("row", F.expr("node_id div 5").cast("int")).withColumn("col", F.expr("node_id % 5"))
    return nodes, _rook(cells, down=False)


def _grid(rows: DataFrame, instance: str, row: str, col: str, name: list[str], x: list) -> tuple[DataFrame, DataFrame]:
    """Populated cells of a grid of two keys; nodes are numbered by (row, col)."""
    cells = rows.groupBy(row, col).agg(F.array(*x).alias("x"))
    rank = lambda c: F.dense_rank().over(Window.orderBy(c)) - 1  # noqa: E731 - over the few distinct keys of an axis
    cells = cells.join(cells.select(row).distinct().withColumn("row", rank(row)), row).join(cells.select(col).distinct().withColumn("col", rank(col)), col)
    cells = cells.select(
        F.lit(instance).alias("instance"),
        (F.row_number().over(Window.partitionBy(F.lit(instance)).orderBy("row", "col")) - 1).alias("node_id"),
        F.concat_ws("/", *name).alias("name"),
        "x",
        "row",
        "col",
    )
    return cells.select("instance", "node_id", "name", "x"), _rook(cells)


def segment_nation(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = [F.avg("c_acctbal"), F.count("*").cast("double")]
    return _grid(_table(spark, sf_dir, "customer"), "segment_nation", "c_mktsegment", "c_nationkey", ["c_mktsegment", "c_nationkey"], x)


def brand_size(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = [F.avg("p_retailprice"), F.count("*").cast("double")]
    return _grid(_table(spark, sf_dir, "part"), "brand_size", "p_brand", "p_size", ["p_brand", "p_size"], x)


def embedding_ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One node per vector, tied to the next and to the one 25 places on."""
    nodes = _table(spark, sf_dir, "embeddings").select(
        F.lit("embedding_ring").alias("instance"),
        F.col("vec_id").cast("int").alias("node_id"),
        F.col("vec_id").cast("string").alias("name"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    steps = nodes.select("instance", F.col("node_id").alias("u"), F.explode(F.array(F.lit(1), F.lit(25))).alias("step"))
    edges = steps.select("instance", "u", (F.col("u") + F.col("step")).alias("v"))
    edges = edges.join(nodes.select("instance", F.col("node_id").alias("v")), ["instance", "v"], "left_semi")
    return nodes, _numbered(edges.select("instance", "u", "v"))


INSTANCES = {
    "nation_lattice": nation_lattice, "nation_rows": nation_rows, "segment_nation": segment_nation, "brand_size": brand_size, "embedding_ring": embedding_ring,
}


def event_results(spark: SparkSession, sf_dir: str, shifted: bool = False) -> DataFrame:
    """Stand-in for experiment results: id = user, heuristic = event type, f and time_s from the values."""
    keys = [F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("heuristic")]
    rows = _table(spark, sf_dir, "events").groupBy(*keys).agg(F.avg("value").alias("f"), F.max("value").alias("time_s"))
    return rows.withColumn("f", F.col("f") + 5.0 * F.length("heuristic")) if shifted else rows
