"""Batch experiments: executions (instance, k, repetition) by heuristics, resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelar.operators.classic import CLASSIC
from parcelar.operators.decoders import as_graph, graph_rows, near, with_graphs
from parcelar.operators.kernels import objective
from parcelar.plans.search import RUN_SCHEMA, SearchConfig, run_kernel
from parcelar.sources.tables import append_results, read_results

GENETIC = {"brkga_mst": "mst", "brkga_st": "shortest", "brkga_greedy": "greedy"}
HEURISTICS = (*GENETIC, *CLASSIC)


def k_schedule(n: Column) -> Column:
    """Numbers of regions for an instance of n nodes: those of its size class that are below n."""
    few, some, many = (F.array(*map(F.lit, v)) for v in ((3, 5, 7), (5, 7, 10), (10, 15, 20)))
    return F.filter(F.when(n < 20, few).when(n < 60, some).otherwise(many), lambda k: k < n)


def execution_ids(nodes: DataFrame, repetitions: int = 3, schedule: Callable[[Column], Column] = k_schedule) -> DataFrame:
    """``instance, n, k, repetition, id``: every instance with each of its region counts and repetitions."""
    sizes = nodes.groupBy("instance").agg(F.count("*").cast("int").alias("n"))
    rows = sizes.select("instance", "n", F.explode(schedule(F.col("n"))).alias("k")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("repetition")
    )
    return rows.withColumn("id", F.concat_ws("__", "instance", "k", "repetition"))


def parse_ids(ids: DataFrame) -> DataFrame:
    """``id, instance, k, repetition`` of ids; an instance name may hold the separator itself."""
    part = r"^(.*)__(\d+)__(\d+)$"
    return ids.select(
        "id", F.regexp_extract("id", part, 1).alias("instance"), F.regexp_extract("id", part, 2).cast("int").alias("k"),
        F.regexp_extract("id", part, 3).cast("int").alias("repetition"),
    )


def pending(ids: DataFrame, results: DataFrame) -> DataFrame:
    """Ids without results; a result row is what makes an id complete."""
    return ids.join(results.select("id").distinct(), "id", "left_anti")


def check_heuristics(names: list[str] | None) -> tuple[str, ...]:
    """The named heuristics, all nine for none; unknown names raise."""
    if unknown := sorted(set(names or ()) - set(HEURISTICS)):
        raise ValueError(f"unknown heuristics: {', '.join(unknown)}")
    return tuple(names or HEURISTICS)


def run_one(graph, k: int, heuristic: str, seed: int, config: SearchConfig, options: dict | None = None) -> dict:
    """One heuristic on one graph: labels, f, seconds, last generation and statistics (genetic ones only)."""
    if not 1 <= k <= graph.n:
        raise ValueError(f"{k} regions of {graph.n} nodes")
    if heuristic in GENETIC:
        found = run_kernel(graph, k, replace(config, seed=seed), GENETIC[heuristic])
        return found | {"last_gen": int(found["statistics"][-1][0])}
    begun = time.monotonic()
    labels = CLASSIC[heuristic](graph, k, seed, **(options or {}).get(heuristic, {}))
    return {"labels": labels, "f": objective(graph, labels), "seconds": time.monotonic() - begun, "last_gen": None, "statistics": []}


def run_tasks(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, config: SearchConfig, options: dict | None = None, partitions: int | None = None) -> DataFrame:
    """Results (see ``RUN_SCHEMA``) of ``tasks (run_id, instance, k, seed, heuristic)``.

    Tasks are independent; each is one row with its graph, dealt evenly over the executors.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                graph = as_graph(r.n, np.asarray(r.xs), np.asarray(r.us), np.asarray(r.vs))
                got = run_one(graph, r.k, r.heuristic, int(r.seed), config, options)
                names = ("generation", "mean", "std", "min", "q10", "q25", "median", "q75", "q90", "elite_cutoff")
                stats = [dict(zip(names, (int(s[0]), *map(float, s[1:])))) for s in got["statistics"]]
                rows.append((r.run_id, r.instance, r.k, r.n, r.heuristic, r.seed, got["f"], got["seconds"], got["last_gen"], got["labels"].astype(np.int32), stats))
            columns = [c.split()[0] for c in RUN_SCHEMA.split(" array<struct")[0].split(", ")]
            out = pd.DataFrame(rows, columns=columns)
            out["last_gen"] = out["last_gen"].astype("Int32")
            yield out

    dealt = tasks.repartition(partitions or int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_id")
    return with_graphs(dealt, near(graph_rows(nodes, edges)), "run_id").select(
        "run_id", "instance", "k", "seed", "heuristic", "n", "xs", "us", "vs"
    ).mapInPandas(kernel, RUN_SCHEMA)


def batch_tasks(ids: DataFrame, heuristics: list[str] | None = None) -> DataFrame:
    """One task per id and heuristic; the repetition is the seed."""
    names = F.array(*map(F.lit, check_heuristics(heuristics)))
    rows = ids.select("*", F.explode(names).alias("heuristic"))
    return rows.select("id", F.concat_ws("__", "id", "heuristic").alias("run_id"), "instance", "k", F.col("repetition").alias("seed"), "heuristic")


def run_batch(
    ids: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    config: SearchConfig,
    heuristics: list[str] | None = None,
    results: DataFrame | None = None,
    options: dict | None = None,
) -> DataFrame:
    """Long results of all ids that ``results`` doesn't have: ``id, n, k, heuristic, f, time_s, last_gen, labels``.

    ``options`` are further arguments of the classic heuristics, by their names.
    """
    todo = pending(ids, results) if results is not None else ids
    tasks = batch_tasks(todo, heuristics)
    done = run_tasks(tasks.drop("id"), nodes, edges, config, options)
    return done.withColumn("id", F.regexp_replace("run_id", "__[a-z_]+$", "")).select("id", "instance", "n", "k", "heuristic", "f", "time_s", "last_gen", "labels")


def run_and_save(
    ids: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    config: SearchConfig,
    path: str,
    heuristics: list[str] | None = None,
    options: dict | None = None,
    waves: int = 10,
) -> DataFrame:
    """:func:`run_batch` in waves of ids, each appended to the results under ``path`` when it is done; all results.

    A wave is whole or absent, so a job that is lost goes on with the ids that have no results.
    """
    spark = ids.sparkSession
    for wave in range(waves):
        mine = ids.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave)
        if not (todo := pending(mine, read_results(spark, path))).isEmpty():
            append_results(run_batch(todo, nodes, edges, config, heuristics, options=options), path)
    return read_results(spark, path)


def results_wide(results: DataFrame, heuristics: list[str]) -> DataFrame:
    """``ID, N, K``, then f of all heuristics, then times, then last generations."""
    wide = results.groupBy(F.col("id").alias("ID"), F.col("n").alias("N"), F.col("k").alias("K")).pivot("heuristic", heuristics)
    wide = wide.agg(F.first("f").alias("f"), F.first("time_s").alias("time"), F.first("last_gen").alias("last_gen"))
    columns = [(f"{h}_{m}", f"{h}__{m}") for m in ("f", "time", "last_gen") for h in heuristics if m != "last_gen" or h in GENETIC]
    return wide.select("ID", "N", "K", *(F.col(a).alias(b) for a, b in columns))


def results_long(wide: DataFrame, metric: str) -> DataFrame:
    """``ID, heuristic, value`` of one metric of the wide table."""
    columns = [c for c in wide.columns if c.endswith(f"__{metric}")]
    return wide.unpivot("ID", columns, "heuristic", "value").withColumn("heuristic", F.regexp_replace("heuristic", f"__{metric}$", ""))


def overview(nodes: DataFrame, ids: DataFrame, heuristics: list[str], repetitions: int) -> DataFrame:
    """One row: numbers of heuristics, instances, repetitions and ids."""
    instances = nodes.agg(F.count_distinct("instance").alias("n_instances"))
    count = ids.agg(F.count("*").alias("n_ids"))
    return instances.join(count, how="cross").select(
        F.lit(len(heuristics)).cast("long").alias("n_heuristics"), "n_instances", F.lit(repetitions).cast("long").alias("n_repetitions"), "n_ids"
    )
