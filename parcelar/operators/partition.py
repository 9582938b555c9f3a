"""Operators on partitions: ``run_id, instance, region INT (from 1), node_id INT``."""

from __future__ import annotations

import colorsys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import BLOCK, tiles


def objective_pairwise(partition: DataFrame, pairs: DataFrame) -> DataFrame:
    """``run_id, f``: per region the distances of its pairs over its size, summed; empty regions add nothing."""
    sizes = partition.groupBy("run_id", "region").agg(F.count("*").alias("n"))
    a = partition.select("run_id", "instance", "region", F.col("node_id").alias("i"))
    b = partition.select("run_id", "instance", "region", F.col("node_id").alias("j"))
    inside = a.join(pairs, ["instance", "i"]).join(b, ["run_id", "instance", "region", "j"])
    sums = inside.groupBy("run_id", "region").agg(F.sum("d").alias("d"))
    per = sizes.join(sums, ["run_id", "region"], "left")
    return per.groupBy("run_id").agg(F.sum(F.coalesce(F.col("d") / F.col("n"), F.lit(0.0))).alias("f"))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the distances of all pairs of two blocks, or of one block and itself."""
    for batch in batches:
        sums = []
        for row in range(len(batch)):
            i, j, a, b = (batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("li", "ri", "lx", "rx"))
            a, b = a.reshape(len(i), -1), b.reshape(len(j), -1)
            d = np.zeros((len(i), len(j)))
            for k in range(a.shape[1]):
                d += (a[:, k, None] - b[None, :, k]) ** 2
            sums.append(float(np.triu(d, 1).sum() if batch["same"][row].as_py() else d.sum()))
        yield pa.RecordBatch.from_arrays([batch["run_id"], batch["region"], pa.array(sums, pa.float64())], names=["run_id", "region", "d"])


def objective_of_nodes(partition: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """:func:`objective_pairwise` from the nodes: pairs are formed inside regions only, in tiles that return their sums.

    A region's nodes are dealt to blocks of about ``block`` by a hash, so a large region spreads over all executors.
    """
    sizes = partition.groupBy("run_id", "region").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    members = partition.join(nodes.select("instance", "node_id", "x"), ["instance", "node_id"]).join(sizes, ["run_id", "region"])
    dealt = members.withColumn("b", F.expr("cast(pmod(xxhash64(node_id), blocks) AS int)"))
    blocks = dealt.groupBy("run_id", "region", "blocks", "b").agg(F.array_sort(F.collect_list(F.struct("node_id", "x"))).alias("rows"))
    blocks = blocks.select("run_id", "region", "blocks", "b", F.col("rows.node_id").alias("ids"), F.flatten("rows.x").alias("xs"))
    sums = tiles(blocks, ["run_id", "region"]).withColumn("same", F.col("lo") == F.col("hi")).mapInArrow(_inside, "run_id string, region int, d double")
    per = sizes.join(sums.groupBy("run_id", "region").agg(F.sum("d").alias("d")), ["run_id", "region"], "left")
    return per.groupBy("run_id").agg(F.sum(F.coalesce(F.col("d") / F.col("n"), F.lit(0.0))).alias("f"))


def objective_centroid(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """``run_id, f``: squared distances to the region's centroid, in time linear in the nodes."""
    long = partition.join(nodes.select("instance", "node_id", F.posexplode("x").alias("dim", "value")), ["instance", "node_id"])
    per = long.groupBy("run_id", "region", "dim").agg((F.var_pop("value") * F.count("*")).alias("s"))
    return per.groupBy("run_id").agg(F.sum("s").alias("f"))


def labels_to_regions(labels: DataFrame) -> DataFrame:
    """``run_id, region, nodes`` from ``run_id, k, labels ARRAY<INT>`` (position = node).

    Every region 1..k has a row, an empty one an empty list; labels outside 1..k are dropped.
    """
    regions = labels.select("run_id", F.explode(F.expr("sequence(1, k)")).alias("region"))
    nodes = labels.select("run_id", F.posexplode("labels").alias("node_id", "region"))
    grouped = nodes.groupBy("run_id", "region").agg(F.array_sort(F.collect_list("node_id")).alias("nodes"))
    empty = F.expr("cast(array() AS array<int>)")
    return regions.join(grouped, ["run_id", "region"], "left").select("run_id", "region", F.coalesce("nodes", empty).alias("nodes"))


def node_region(partition: DataFrame, wanted: DataFrame) -> DataFrame:
    """``run_id, node_id, region`` for ``wanted (run_id, node_id)``; null where the node is in no region."""
    found = partition.groupBy("run_id", "node_id").agg(F.min("region").alias("region"))
    return wanted.join(found, ["run_id", "node_id"], "left")


def region_names(partition: DataFrame, nodes: DataFrame) -> DataFrame:
    """``run_id, region, names`` in node order."""
    named = partition.join(nodes.select("instance", "node_id", "name"), ["instance", "node_id"])
    sorted_pairs = F.array_sort(F.collect_list(F.struct("node_id", "name")))
    return named.groupBy("run_id", "region").agg(F.transform(sorted_pairs, lambda p: p["name"]).alias("names"))


def palette(n: int) -> dict[int, str]:
    """``{1: '#rrggbb', ...}`` with evenly spread hues."""
    return {i + 1: "#" + "".join(f"{round(255 * c):02x}" for c in colorsys.hsv_to_rgb(i / max(1, n), 0.65, 0.9)) for i in range(n)}


def map_colors(partition: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Data behind a map: ``run_id, node_id, name, region, color``; nodes in no region have nulls."""
    table = F.map_from_arrays(*(F.array(*map(F.lit, side)) for side in zip(*palette(k).items())))
    runs = partition.select("run_id", "instance").distinct()
    every = runs.join(nodes.select("instance", "node_id", "name"), "instance")
    found = every.join(partition.select("run_id", "node_id", "region"), ["run_id", "node_id"], "left")
    return found.select("run_id", "node_id", "name", "region", F.try_element_at(table, F.col("region")).alias("color"))


def feasible_elements(partition: DataFrame, pairs: DataFrame, adjacent: DataFrame) -> DataFrame:
    """``run_id, node_id, region, g`` of every node without a region beside a region, with its greedy score.

    The score is what the objective gains: (sum of distances to the region - the region's own cost) over
    (its size + 1), with the region's cost from its pairs.
    """
    both = pairs.select("instance", "i", "j", "d").unionByName(pairs.select("instance", F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    sizes = partition.groupBy("run_id", "region").agg(F.count("*").alias("n"))
    a = partition.select("run_id", "instance", "region", F.col("node_id").alias("i"))
    inside = a.join(pairs, ["instance", "i"]).join(a.withColumnRenamed("i", "j"), ["run_id", "instance", "region", "j"])
    cost = inside.groupBy("run_id", "region").agg(F.sum("d").alias("d"))
    beside = a.join(adjacent.withColumnRenamed("node_id", "i"), ["instance", "i"]).select("run_id", "instance", "region", F.col("neighbour").alias("v"))
    taken = partition.select("run_id", F.col("node_id").alias("v"))
    free = beside.join(taken, ["run_id", "v"], "left_anti").distinct()
    sums = free.join(a, ["run_id", "instance", "region"]).join(both.withColumnRenamed("j", "v"), ["instance", "i", "v"])
    sums = sums.groupBy("run_id", "v", "region").agg(F.sum("d").alias("s"))
    scored = sums.join(sizes, ["run_id", "region"]).join(cost, ["run_id", "region"], "left")
    g = (F.col("s") - F.coalesce(F.col("d") / F.col("n"), F.lit(0.0))) / (F.col("n") + 1)
    return scored.select("run_id", F.col("v").alias("node_id"), "region", g.alias("g"))
