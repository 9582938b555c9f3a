"""Decoding populations of chromosomes into partitions.

``population``: run_id, instance, k, generation, chrom, genes ARRAY<DOUBLE>.  The graph of an instance
travels as one row of arrays that is joined to its chromosomes, so decoding is spread over chromosomes
and instances alike.  The spanning-tree decoder also exists as a native array fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelar.operators.features import edge_dissimilarity
from parcelar.operators.kernels import DECODERS, Graph, objective, seed_lengths

#: Bytes of one instance's arrays up to which the table of graphs may be broadcast, and its rows.
BROADCAST_ROWS, BROADCAST_VALUES = 200, 2_000_000
#: Parts into which the rows of one instance are dealt where its graph is shuffled.
SALTS = 16


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``instance, n, xs, us, vs``: one row of arrays per instance."""
    a = nodes.groupBy("instance").agg(
        F.count("*").cast("int").alias("n"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "x"))), lambda s: s["x"])).alias("xs"),
    )
    listed = F.array_sort(F.collect_list(F.struct("edge_id", "u", "v")))
    b = edges.groupBy("instance").agg(
        F.transform(listed, lambda s: s["u"]).alias("us"), F.transform(listed, lambda s: s["v"]).alias("vs")
    )
    none = F.expr("cast(array() AS array<int>)")
    return a.join(b, "instance", "left").select("instance", "n", "xs", F.coalesce("us", none).alias("us"), F.coalesce("vs", none).alias("vs"))


def near(graphs: DataFrame) -> DataFrame:
    """The graphs, marked for broadcast if they are counted to be small, else once for each part of their rows."""
    size = graphs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("xs") + 2 * F.size("us")), F.lit(0)).alias("values")).first()
    small = size["rows"] <= BROADCAST_ROWS and size["values"] <= BROADCAST_VALUES
    return F.broadcast(graphs) if small else graphs.withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))


def with_graphs(rows: DataFrame, graphs: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the graphs of :func:`near`; the rows of an instance are dealt by their ``keys``."""
    if "salt" not in graphs.columns:
        return rows.join(graphs, "instance")
    return rows.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(graphs, ["instance", "salt"]).drop("salt")


def as_graph(n: int, xs, us, vs) -> Graph:
    return Graph(np.asarray(xs, float).reshape(n, -1), np.asarray(us, int), np.asarray(vs, int))


def _decode(method: str):
    decode = DECODERS[method]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[str, Graph] = {}
        for batch in batches:
            rows = [batch[c].to_pylist() for c in ("instance", "n", "k")]
            regions, f = [], []
            for i, (name, n, k) in enumerate(zip(*rows)):
                if name not in graphs:
                    if len(graphs) > 50:
                        graphs.clear()
                    graphs[name] = as_graph(n, *(batch[c][i].values.to_numpy() for c in ("xs", "us", "vs")))
                found = decode(graphs[name], k, batch["genes"][i].values.to_numpy())
                regions.append(found.astype(np.int32))
                f.append(objective(graphs[name], found))
            keep = ("run_id", "instance", "k", "generation", "chrom")
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in keep), pa.array(regions, pa.list_(pa.int32())), pa.array(f, pa.float64())], names=[*keep, "labels", "f"]
            )

    return kernel


def decode(population: DataFrame, nodes: DataFrame, edges: DataFrame, method: str, graphs: DataFrame | None = None) -> DataFrame:
    """``run_id, instance, k, generation, chrom, labels, f``; label 0 for nodes that greedy growth can't reach.

    ``graphs`` are the rows of :func:`graph_rows` where they are at hand already.
    """
    if method not in DECODERS:
        raise ValueError(f"unknown decoder {method!r}")
    joined = with_graphs(population, graphs if graphs is not None else near(graph_rows(nodes, edges)), "run_id", "chrom")
    columns = joined.select("run_id", "instance", "k", "generation", "chrom", "genes", "n", "xs", "us", "vs")
    return columns.mapInArrow(_decode(method), "run_id string, instance string, k int, generation int, chrom int, labels array<int>, f double")


def decode_mst_native(population: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, instance, k, generation, chrom, labels`` by folds over sorted edge arrays, all in the JVM.

    The first fold is Kruskal's algorithm with a label per node; the second joins the labels of the kept
    edges.  Each step rewrites an array of labels, so this suits graphs of some hundred nodes.
    """
    weighted = edge_dissimilarity(nodes, edges)
    listed = weighted.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("edge_id", "u", "v", "d"))).alias("es"))
    counted = nodes.groupBy("instance").agg(F.count("*").cast("int").alias("n"))
    rows = population.join(listed.join(counted, "instance"), "instance")
    perturbed = (
        "array_sort(transform(es, e -> struct(genes[e.edge_id] * e.d AS wm, e.edge_id AS id, e.u AS u, e.v AS v, "
        "-genes[size(es) + e.edge_id] AS wp)))"
    )
    merge = "transform({0}.labels, l -> IF(l = greatest({0}.labels[e.u], {0}.labels[e.v]), least({0}.labels[e.u], {0}.labels[e.v]), l))"
    kept = "array<struct<wp:double,wm:double,id:int,u:int,v:int>>"
    tree = (
        f"aggregate(sorted, struct(sequence(0, n - 1) AS labels, cast(array() AS {kept}) AS kept), (a, e) -> IF(a.labels[e.u] = a.labels[e.v], a, "
        f"struct({merge.format('a')} AS labels, concat(a.kept, array(struct(e.wp AS wp, e.wm AS wm, e.id AS id, e.u AS u, e.v AS v))) AS kept)), a -> a.kept)"
    )
    labels = f"aggregate(slice(array_sort(tree), k, n), struct(sequence(0, n - 1) AS labels), (a, e) -> struct({merge.format('a')} AS labels), a -> a.labels)"
    return (
        rows.withColumn("sorted", F.expr(perturbed))
        .withColumn("tree", F.expr(tree))
        .withColumn("roots", F.expr(labels))
        .withColumn("order", F.expr("array_sort(array_distinct(roots))"))
        .select("run_id", "instance", "k", "generation", "chrom", F.expr("transform(roots, r -> cast(array_position(order, r) AS int))").alias("labels"))
    )


def spanning_edges_native(weights: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """``instance, edge_id`` of the minimum spanning forest of ``weights (instance, edge_id, u, v, w)``."""
    listed = weights.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("w", "edge_id", "u", "v"))).alias("es")).join(n_nodes, "instance")
    merge = "transform(a.labels, l -> IF(l = greatest(a.labels[e.u], a.labels[e.v]), least(a.labels[e.u], a.labels[e.v]), l))"
    tree = (
        "aggregate(es, struct(sequence(0, n - 1) AS labels, cast(array() AS array<int>) AS kept), (a, e) -> IF(a.labels[e.u] = a.labels[e.v], a, "
        f"struct({merge} AS labels, concat(a.kept, array(e.edge_id)) AS kept)), a -> a.kept)"
    )
    return listed.select("instance", F.explode(F.expr(tree)).alias("edge_id"))


def seed_distances(population: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, chrom, region, seed, node_id, length``: perturbed path lengths from each seed; null if there is no path."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                chosen, length = seed_lengths(as_graph(r["n"], r["xs"], r["us"], r["vs"]), r["k"], np.array(r["genes"]))
                k, n = length.shape
                flat = length.ravel()
                yield pa.RecordBatch.from_pydict(
                    {
                        "run_id": [r["run_id"]] * (k * n), "chrom": pa.array([r["chrom"]] * (k * n), pa.int32()),
                        "region": np.repeat(np.arange(1, k + 1, dtype=np.int32), n), "seed": np.repeat(chosen, n).astype(np.int32),
                        "node_id": np.tile(np.arange(n, dtype=np.int32), k), "length": pa.array(flat, mask=np.isinf(flat)),
                    }
                )

    joined = with_graphs(population, near(graph_rows(nodes, edges)), "run_id", "chrom").select("run_id", "chrom", "k", "genes", "n", "xs", "us", "vs")
    return joined.mapInArrow(kernel, "run_id string, chrom int, region int, seed int, node_id int, length double")


def partition_of(decoded: DataFrame) -> DataFrame:
    """``run_id, instance, generation, chrom, region, node_id`` of decoded labels."""
    return decoded.select("run_id", "instance", "generation", "chrom", F.posexplode("labels").alias("node_id", "region")).where("region > 0")


def region_components(decoded: DataFrame, edges: DataFrame) -> DataFrame:
    """``run_id, chrom, regions, parts``: numbers of regions and of connected parts; equal if all regions hang together.

    One equi-join of edges with labels, then a fold per chromosome over the edges inside regions.
    """
    listed = edges.groupBy("instance").agg(F.array_sort(F.collect_list(F.struct("edge_id", "u", "v"))).alias("es"))
    merge = "transform(a, l -> IF(l = greatest(a[e.u], a[e.v]), least(a[e.u], a[e.v]), l))"
    fold = f"aggregate(filter(es, e -> labels[e.u] = labels[e.v]), sequence(0, size(labels) - 1), (a, e) -> {merge})"
    return decoded.join(listed, "instance").select(
        "run_id", "chrom", F.size(F.array_distinct("labels")).alias("regions"), F.size(F.array_distinct(F.expr(fold))).alias("parts")
    )


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``instance, node_id, component`` (smallest node) for graphs of any size, by large-star and small-star steps.

    Each step replaces edges by edges to the smallest neighbour, until every component is a star around
    its smallest node; the number of steps grows with the logarithm of a component's size.  Steps run until
    nothing changes and are checkpointed in the shared folder.  Edges with a node that ``nodes`` lacks count
    as none.
    """
    from parcelar.plans.state import checkpoint

    known = nodes.select("instance", "node_id").distinct()
    near = edges.where("u <> v").select("instance", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for end in ("u", "v"):
        near = near.join(known.withColumnRenamed("node_id", end), ["instance", end], "left_semi")
    now = checkpoint(near.select("instance", "u", "v"))
    before = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("instance", "u", "v")).alias("x")).first()
        if (state := (found["n"], found["x"])) == before or found["n"] == 0:
            break
        before = state
        both = now.union(now.select("instance", "v", "u"))
        least = both.groupBy("instance", "u").agg(F.min("v").alias("m")).select("instance", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["instance", "u"]).where("v > u").select("instance", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("instance", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["instance", "u"]).where("v <> m").select("instance", F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.union(least.select("instance", "u", F.col("m").alias("v"))).distinct())
    roots = now.select("instance", F.col("u").alias("node_id"), F.col("v").alias("component"))
    return nodes.select("instance", "node_id").join(roots, ["instance", "node_id"], "left").select(
        "instance", "node_id", F.coalesce("component", "node_id").alias("component")
    )
