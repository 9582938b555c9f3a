"""Graph and feature operators: distances, adjacency, contiguity through shared points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelar.functions.vectors import squared_distance

#: Nodes of a block; pairs of blocks are the unit of work inside regions.
BLOCK = 128
#: Nodes of a block where all pairs of an instance are wanted, blocks that a task meets on each side, the most parts of
#: blocks (tasks are their square), and pairs that leave a task at a time.
ALL_BLOCK, SIDE, MOST_PARTS, BATCH_PAIRS = 512, 4, 200, 1 << 16


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero after scaling, as SQL rounds; ``d`` isn't negative."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = d * 10.0**digits
        whole = np.floor(scaled)
        whole += scaled - whole >= 0.5
        return np.where(np.isfinite(scaled), whole / 10.0**digits, d)


def _tile(batches: Iterator[pa.RecordBatch], digits: int | None, named: bool) -> Iterator[pa.RecordBatch]:
    """Distances of all pairs i < j of two blocks, whichever comes first, some rows of the first block at a time."""
    for batch in batches:
        for row in range(len(batch)):
            i, j, a, b = (batch[c][row].values.to_numpy(zero_copy_only=False) for c in ("li", "ri", "lx", "rx"))
            a, b = a.reshape(len(i), -1), b.reshape(len(j), -1)
            if i[0] > j[0]:
                i, j, a, b = j, i, b, a
            name, b = pa.scalar(batch["instance"][row].as_py(), pa.string()), np.ascontiguousarray(b.T)
            step = max(1, BATCH_PAIRS // len(j))
            for start in range(0, len(i), step):
                u, x = i[start : start + step], a[start : start + step]
                d, part = np.zeros((len(u), len(j))), np.empty((len(u), len(j)))
                for k in range(len(b)):  # in order of the components
                    np.subtract(x[:, k, None], b[k], out=part)
                    np.multiply(part, part, out=part)
                    d += part
                p, q, d = np.repeat(u, len(j)), np.tile(j, len(u)), d.ravel()
                if i[-1] >= j[0]:  # a block and itself
                    wanted = p < q
                    p, q, d = p[wanted], q[wanted], d[wanted]
                if digits is not None:
                    d = _rounded(d, digits)
                pairs = {"i": pa.array(p, pa.int32()), "j": pa.array(q, pa.int32()), "d": pa.array(d)}
                yield pa.RecordBatch.from_pydict({"instance": pa.repeat(name, len(p))} | pairs if named else pairs)


def tiles(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lo, hi, li, lx, ri, rx``: each two blocks lo <= hi of ``blocks (keys, b, blocks, ids, xs)``, a block and itself included.

    The sides are sorted and merged whatever the broadcast threshold is: Spark judges them by the blocks' size, before
    each is repeated for all its tiles, and would collect that many times the nodes in the driver.
    """
    left = blocks.select(*keys, F.col("ids").alias("li"), F.col("xs").alias("lx"), F.col("b").alias("lo"), F.explode(F.expr("sequence(b, blocks - 1)")).alias("hi"))
    right = blocks.select(*keys, F.col("ids").alias("ri"), F.col("xs").alias("rx"), F.explode(F.expr("sequence(0, b)")).alias("lo"), F.col("b").alias("hi"))
    return left.join(right.hint("merge"), [*keys, "lo", "hi"]).select(*keys, "lo", "hi", "li", "lx", "ri", "rx")


def pairwise_dissimilarity(nodes: DataFrame, block: int = ALL_BLOCK, digits: int | None = None, named: bool = True) -> DataFrame:
    """``instance, i, j, d`` for all pairs i < j of an instance: squared Euclidean distances, rounded if ``digits`` are given.

    Not ``named``, pairs come without their instance, which costs less where there is only one.

    The result is quadratic by definition, what goes to disk for it is not: blocks of ``block`` nodes are rows of arrays,
    shuffled once and dealt to parts, and each two parts meet in a task that reads both (a Cartesian product; an equi-join
    would write each block for each of its tiles).  The parts follow from the counted blocks, so that tasks are as large
    whatever the table is.  No side is broadcast.  Instances of one block need no partner.
    """
    nodes = nodes.dropna(subset=["instance", "node_id"]).withColumn("b", F.expr(f"node_id div {block}").cast("int"))
    several = nodes.groupBy("instance").agg(F.count_distinct("b").alias("blocks")).where("blocks > 1")
    count = several.agg(F.sum("blocks")).first()[0] or 0
    listed = F.array_sort(F.collect_list(F.struct("node_id", "x")))
    blocks = nodes.groupBy("instance", "b").agg(listed.alias("rows")).select("instance", "b", F.col("rows.node_id").alias("ids"), F.flatten("rows.x").alias("xs"))
    alone = blocks.join(several, "instance", "left_anti") if count else blocks
    found = alone.select("instance", F.col("ids").alias("li"), F.col("xs").alias("lx"), F.col("ids").alias("ri"), F.col("xs").alias("rx"))
    if count:
        parts = min(MOST_PARTS, max(min(count, SIDE), count // SIDE))
        dealt = blocks.join(several, "instance", "left_semi").repartition(parts)  # without a key: as many blocks to each
        left = dealt.select("instance", F.col("b").alias("lb"), F.col("ids").alias("li"), F.col("xs").alias("lx"))
        right = dealt.select(F.col("instance").alias("other"), F.col("b").alias("rb"), F.col("ids").alias("ri"), F.col("xs").alias("rx"))
        once = F.expr("instance = other AND (lb = rb OR (lb < rb) = ((lb + rb) % 2 = 0))")  # each two blocks one way round, either way as often
        found = found.unionByName(left.join(right.hint("shuffle_replicate_nl"), once).select(*found.columns))
    return found.mapInArrow(partial(_tile, digits=digits, named=named), "instance string, " * named + "i int, j int, d double")


def edge_dissimilarity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with d, the squared distance of their ends; linear in the edges."""
    ends = lambda c: nodes.select("instance", F.col("node_id").alias(c), F.col("x").alias(f"x_{c}"))
    both = edges.join(ends("u"), ["instance", "u"]).join(ends("v"), ["instance", "v"])
    return both.select("instance", "edge_id", "u", "v", squared_distance("x_u", "x_v").alias("d"))


def feature_flatten(nodes: DataFrame, width: int) -> DataFrame:
    """``instance, node_id, name, x_1 .. x_width``."""
    return nodes.select("instance", "node_id", "name", *(F.col("x")[i].alias(f"x_{i + 1}") for i in range(width)))


def node_points(edges: DataFrame) -> DataFrame:
    """``instance, node_id, points``: one point (u, v) for each edge at a node, sorted."""
    ends = edges.select("instance", F.explode(F.array("u", "v")).alias("node_id"), F.struct(F.col("u").alias("px"), F.col("v").alias("py")).alias("p"))
    return ends.groupBy("instance", "node_id").agg(F.array_sort(F.collect_set("p")).alias("points"))


def shared_point_contiguity(points: DataFrame) -> DataFrame:
    """``instance, node_id, neighbour``: nodes that share a point, both ways."""
    each = points.select("instance", "node_id", F.explode("points").alias("p"))
    other = each.select("instance", F.col("node_id").alias("neighbour"), "p")
    return each.join(other, ["instance", "p"]).where("node_id <> neighbour").select("instance", "node_id", "neighbour").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """``instance, node_id, neighbour`` of an edge table, both ways."""
    back = edges.select("instance", F.col("v").alias("node_id"), F.col("u").alias("neighbour"))
    return edges.select("instance", F.col("u").alias("node_id"), F.col("v").alias("neighbour")).union(back).distinct()


def neighbour_lists(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("instance", "node_id").agg(F.array_sort(F.collect_list("neighbour")).alias("neighbours"))


def contiguity_difference(edges: DataFrame) -> DataFrame:
    """Rows in one only of the adjacency and its round trip through shared points; none if all is well."""
    a, b = adjacency(edges), shared_point_contiguity(node_points(edges))
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def without_edges(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("instance", "edge_id"), ["instance", "edge_id"], "left_anti")


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``instance, n_nodes, n_edges``."""
    n = nodes.groupBy("instance").agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy("instance").agg(F.count("*").alias("n_edges"))
    return n.join(m, "instance", "left").select("instance", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
