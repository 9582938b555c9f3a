"""Connected components of an edge table: forests of parts, then one task or alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, giving_back

#: Parts into which the edges of one node are dealt where they meet its minimum.
SALTS = 16
#: Edges that one task settles at once (about 100 bytes each there); more go through the steps.
AT_ONCE = 2_000_000
#: Rows of a batch that goes back to the JVM.
OUT = 65536


def smallest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest item of each item's component, for edges between the items ``a`` and ``b``.

    Roots are hooked to their smallest neighbour and paths are flattened; two rounds at least halve the roots that
    still have an edge.
    """
    root = np.arange(count)
    while True:
        a, b = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = a < b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        np.minimum.at(root, b, a)
        while ((up := root[root]) != root).any():
            root = up


def _forest(at_once: int):
    """Edges from each node to the smallest of its component, among ``at_once`` edges of a part at a time."""

    def settle(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
        nodes, spot = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = smallest(len(nodes), spot[: len(u)], spot[len(u) :])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        for lo in range(0, len(moved), OUT):
            some = moved[lo : lo + OUT]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["u", "v"])

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= at_once:
                yield from settle(held)
                held, rows = [], 0
        if rows:
            yield from settle(held)

    return forest


def connected_components(edges: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u long, v long)`` that isn't the smallest of its component.

    Each part of the edges is replaced by its own forest of stars where it lies.  If these have ``at_once`` edges or
    fewer together, one task joins them: one shuffle, and no plan that repeats in the driver.

    More edges go through steps.  Each replaces edges by edges to the smallest neighbour, until every component is a
    star around its smallest node; the number of steps grows with the logarithm of a component's size.  Only minima
    are taken per node, which Spark combines before it shuffles, and each step is checkpointed.  The edges of
    a node meet its minimum in ``SALTS`` parts, so the centre of a large star isn't one task's work; these joins are
    never broadcast, since Spark judges the minima by their size before they are repeated for the parts.  Loops
    and repeated edges do no harm; no edges give no rows.
    """
    salts = F.explode(F.expr(f"sequence(0, {SALTS - 1})")).alias("salt")

    def meet(some: DataFrame, least: DataFrame) -> DataFrame:
        salted = some.withColumn("salt", F.expr(f"cast(pmod(xxhash64(v), {SALTS}) AS int)"))
        return salted.join(least.select("u", "m", salts).hint("merge"), ["u", "salt"])

    kinds = "u long, v long"
    now = checkpoint(edges.where("u <> v").select("u", "v").mapInArrow(giving_back(_forest(AT_ONCE)), kinds))
    before = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state := (found["n"], found["x"])) == before or found["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        if found["n"] <= at_once:
            joined = now.repartition(1).mapInArrow(giving_back(_forest(found["n"] + 1)), kinds)
            return checkpoint(joined).select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
