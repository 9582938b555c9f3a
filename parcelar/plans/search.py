"""Biased random-key genetic search.

Every random number is a pure function of (seed, generation, chromosome, gene), so the generation step
as a DataFrame plan and the whole-run kernel give the same populations.  The plan serves populations too
large for one task; the kernel serves many runs, one task each, which is the way to throughput.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelar.functions.keys import CROSS_DRAW, ELITE_DRAW, OTHER_DRAW, key_sql, keys, place_sql
from parcelar.operators.decoders import decode, graph_rows, near
from parcelar.operators.kernels import DECODERS, Graph, chromosome_length, objective
from parcelar.plans.state import checkpoint

#: An improvement smaller than this doesn't count.
LEAST_GAIN = 1e-4


@dataclass(frozen=True)
class SearchConfig:
    population_size: int = 100
    elite_fraction: float = 0.2
    mutant_fraction: float = 0.2
    crossover_rate: float = 0.7
    max_generations: int = 100
    tolerance_generations: int = 100
    max_time: float | None = 3600.0
    seed: int = 0

    def __post_init__(self):
        if not 0 < self.elite_fraction < 0.5:
            raise ValueError("elite_fraction must lie in (0, 0.5)")
        if not 0 < self.mutant_fraction < 1 or self.elite_fraction + self.mutant_fraction >= 1:
            raise ValueError("mutant_fraction must lie in (0, 1), and both fractions must leave room for offspring")
        if not 0.5 < self.crossover_rate < 1:
            raise ValueError("crossover_rate must lie in (0.5, 1)")
        if self.elite < 1 or self.population_size - self.elite < 1:
            raise ValueError("the population is too small for an elite and others")

    @property
    def elite(self) -> int:
        return int(self.population_size * self.elite_fraction)

    @property
    def mutants(self) -> int:
        return int(self.population_size * self.mutant_fraction)

    @property
    def offspring(self) -> int:
        return self.population_size - self.elite - self.mutants


# -- as DataFrames -----------------------------------------------------------------------------------


def random_chromosomes(runs: DataFrame, first: int, count: int, generation: int) -> DataFrame:
    """Chromosomes ``first .. first + count - 1`` for ``runs (run_id, instance, k, seed, length)``."""
    rows = runs.select("*", F.lit(generation).alias("generation"), F.explode(F.sequence(F.lit(first), F.lit(first + count - 1))).alias("chrom"))
    genes = f"transform(sequence(0, length - 1), g -> {key_sql('seed', place_sql('generation', 'chrom', 'g'))})"
    return rows.select("run_id", "instance", "k", "seed", "generation", "chrom", F.expr(genes).alias("genes"))


def ranked(population: DataFrame) -> DataFrame:
    """Adds rank, from 1 by (f, chrom), inside each run and generation."""
    return population.withColumn("rank", F.row_number().over(Window.partitionBy("run_id", "generation").orderBy("f", "chrom")))


def crossover(ranked_population: DataFrame, config: SearchConfig, generation: int) -> DataFrame:
    """Children ``elite .. elite + offspring - 1``: each gene from an elite parent with the crossover rate."""
    p, e = config.population_size, config.elite
    runs = ranked_population.select("run_id", "instance", "k", "seed").distinct()
    children = runs.select("*", F.lit(generation).alias("generation"), F.explode(F.sequence(F.lit(e), F.lit(e + config.offspring - 1))).alias("chrom"))

    def draw(gene: int) -> str:
        return key_sql("seed", place_sql("generation", "chrom", str(gene)))

    children = children.withColumn("elite_rank", F.expr(f"CAST(floor({draw(ELITE_DRAW)} * {e}) AS int) + 1"))
    children = children.withColumn("other_rank", F.expr(f"CAST(floor({draw(OTHER_DRAW)} * {p - e}) AS int) + {e + 1}"))
    parents = ranked_population.select("run_id", "rank", "genes")
    both = children.join(parents.select("run_id", F.col("rank").alias("elite_rank"), F.col("genes").alias("a")), ["run_id", "elite_rank"]).join(
        parents.select("run_id", F.col("rank").alias("other_rank"), F.col("genes").alias("b")), ["run_id", "other_rank"]
    )
    coin = key_sql("seed", place_sql("generation", "chrom", f"{CROSS_DRAW} + g"))
    genes = f"transform(a, (x, g) -> IF({coin} <= {config.crossover_rate}D, x, b[g]))"
    return both.select("run_id", "instance", "k", "seed", "generation", "chrom", F.expr(genes).alias("genes"), "elite_rank", "other_rank")


def next_generation(
    population: DataFrame, nodes: DataFrame, edges: DataFrame, config: SearchConfig, method: str, generation: int, graphs: DataFrame | None = None
) -> DataFrame:
    """The following population with f: elite as they are, children and mutants decoded anew."""
    order = ranked(population)
    elite = order.where(F.col("rank") <= config.elite).select(
        "run_id", "instance", "k", "seed", F.lit(generation).alias("generation"), (F.col("rank") - 1).cast("int").alias("chrom"), "genes", "f"
    )
    children = crossover(order, config, generation).drop("elite_rank", "other_rank")
    runs = population.groupBy("run_id", "instance", "k", "seed").agg(F.max(F.size("genes")).alias("length"))
    mutants = random_chromosomes(runs, config.elite + config.offspring, config.mutants, generation)
    new = children.unionByName(mutants)
    return elite.unionByName(with_fitness(new, nodes, edges, method, graphs))


def with_fitness(population: DataFrame, nodes: DataFrame, edges: DataFrame, method: str, graphs: DataFrame | None = None) -> DataFrame:
    """``population`` with f, always by the true distances."""
    scored = decode(population, nodes, edges, method, graphs).select("run_id", "generation", "chrom", "f")
    return population.join(scored, ["run_id", "generation", "chrom"]).select("run_id", "instance", "k", "seed", "generation", "chrom", "genes", "f")


def population_statistics(population: DataFrame, config: SearchConfig) -> DataFrame:
    """One row per run and generation: mean, std, min, q10 .. q90 and elite_cutoff."""
    quantile = lambda q: F.percentile("f", F.lit(q))
    return population.groupBy("run_id", "generation").agg(
        F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"), F.min("f").alias("min"),
        quantile(0.10).alias("q10"), quantile(0.25).alias("q25"), quantile(0.50).alias("median"), quantile(0.75).alias("q75"),
        quantile(0.90).alias("q90"), quantile(config.elite / config.population_size).alias("elite_cutoff"),
    )


def run_plan(runs: DataFrame, nodes: DataFrame, edges: DataFrame, config: SearchConfig, method: str) -> tuple[DataFrame, DataFrame]:
    """(last population, statistics) of searches for ``runs (run_id, instance, k, seed, length)``.

    All runs advance together; a generation is one plan, checkpointed.  The loop ends when each run has
    been stale for the tolerance, at the last generation or after the time limit.
    """
    begun = time.monotonic()
    graphs = near(checkpoint(graph_rows(nodes, edges)))
    population = checkpoint(with_fitness(random_chromosomes(runs, 0, config.population_size, 0), nodes, edges, method, graphs))
    statistics = [population_statistics(population, config)]
    can_stop = config.tolerance_generations < config.max_generations
    for generation in range(1, config.max_generations + 1):
        population = checkpoint(next_generation(population, nodes, edges, config, method, generation, graphs))
        statistics.append(population_statistics(population, config))
        if can_stop:
            statistics = [checkpoint(reduce(DataFrame.unionByName, statistics))]
            if tolerance_stop(statistics[0], config.tolerance_generations).where("stopped_at IS NULL").isEmpty():
                break
        if config.max_time is not None and time.monotonic() - begun > config.max_time:
            break
    return population, reduce(DataFrame.unionByName, statistics)


def tolerance_stop(statistics: DataFrame, tolerance: int) -> DataFrame:
    """``run_id, best, stopped_at``: a fold over each run's minima; null while it goes on.

    The best value moves only by improvements of more than 1e-4; the run stops once as many generations
    in a row as the tolerance brought none, and after generation 1 if the tolerance is 0.
    """
    minima = statistics.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("generation", "min"))).alias("s"))
    step = (
        "(a, g) -> IF(a.stopped_at IS NOT NULL, a, IF(g.min + 1e-4D < a.best, "
        "struct(g.min AS best, 0 AS stale, IF({0} <= 0, g.generation, cast(null AS int)) AS stopped_at), "
        "struct(a.best AS best, a.stale + 1 AS stale, IF(a.stale + 1 >= {0}, g.generation, cast(null AS int)) AS stopped_at)))"
    ).format(tolerance)
    start = "struct(s[0].min AS best, 0 AS stale, cast(null AS int) AS stopped_at)"
    return minima.select("run_id", F.expr(f"aggregate(slice(s, 2, size(s)), {start}, {step})").alias("r")).select("run_id", "r.best", "r.stopped_at")


def last_improvement(statistics: DataFrame) -> DataFrame:
    """``run_id, last_gen, improved_at``: the last generation, and the last whose minimum, rounded to 4 places, fell."""
    before = F.lag(F.round("min", 4)).over(Window.partitionBy("run_id").orderBy("generation"))
    fell = statistics.withColumn("fell", F.round("min", 4) - before < 0)
    improved = F.coalesce(F.max(F.when(F.col("fell"), F.col("generation"))), F.lit(0))
    return fell.groupBy("run_id").agg(F.max("generation").alias("last_gen"), improved.alias("improved_at"), F.min("min").alias("best"))


def evolution_series(statistics: DataFrame) -> DataFrame:
    """Data behind an evolution plot: one row per run, generation and series."""
    return statistics.unpivot(["run_id", "generation"], ["q25", "q75", "mean", "median", "elite_cutoff", "min"], "series", "value")


# -- as a kernel -------------------------------------------------------------------------------------


def run_kernel(graph: Graph, k: int, config: SearchConfig, method: str) -> dict:
    """One whole search: labels, f, genes, one list of statistics per generation, seconds."""
    begun = time.monotonic()
    decode_one = DECODERS[method]
    length = chromosome_length(method, graph.n, graph.m)
    gene = np.arange(length)
    p, e, seed = config.population_size, config.elite, config.seed
    fitness = lambda rows: np.array([objective(graph, decode_one(graph, k, r)) for r in rows])
    population = keys(seed, 0, np.arange(p)[:, None], gene[None, :])
    f = fitness(population)
    statistics = [_statistics(0, f, e / p)]
    best, stale = f.min(), 0
    for generation in range(1, config.max_generations + 1):
        order = np.lexsort((np.arange(p), f))
        population, f = population[order], f[order]
        child = np.arange(e, e + config.offspring)
        a = np.floor(keys(seed, generation, child, np.int64(ELITE_DRAW)) * e).astype(int)
        b = np.floor(keys(seed, generation, child, np.int64(OTHER_DRAW)) * (p - e)).astype(int) + e
        coin = keys(seed, generation, child[:, None], CROSS_DRAW + gene[None, :]) <= config.crossover_rate
        children = np.where(coin, population[a], population[b])
        mutants = keys(seed, generation, np.arange(e + config.offspring, p)[:, None], gene[None, :])
        new = np.concatenate([children, mutants])
        population, f = np.concatenate([population[:e], new]), np.concatenate([f[:e], fitness(new)])
        statistics.append(_statistics(generation, f, e / p))
        if f.min() + LEAST_GAIN < best:
            best, stale = f.min(), 0
        else:
            stale += 1
        if stale >= config.tolerance_generations or (config.max_time is not None and time.monotonic() - begun > config.max_time):
            break
    top = int(np.lexsort((np.arange(p), f))[0])
    labels = decode_one(graph, k, population[top])
    return {"labels": labels, "f": float(f[top]), "genes": population[top], "statistics": statistics, "seconds": time.monotonic() - begun}


def _statistics(generation: int, f: np.ndarray, elite: float) -> tuple:
    return (generation, f.mean(), f.std(), f.min(), *np.quantile(f, [0.1, 0.25, 0.5, 0.75, 0.9, elite]))


RUN_SCHEMA = (
    "run_id string, instance string, k int, n int, heuristic string, seed int, f double, time_s double, last_gen int, labels array<int>, "
    "stats array<struct<generation:int,mean:double,std:double,min:double,q10:double,q25:double,median:double,q75:double,q90:double,elite_cutoff:double>>"
)


def search_runs(tasks: DataFrame, nodes: DataFrame, edges: DataFrame, config: SearchConfig, partitions: int | None = None) -> DataFrame:
    """Whole searches for ``tasks (run_id, instance, k, seed, heuristic)``, one kernel run per row."""
    from parcelar.plans.batch import run_tasks

    return run_tasks(tasks, nodes, edges, config, partitions=partitions)


def statistics_of(results: DataFrame) -> DataFrame:
    """Population statistics in long form from the ``stats`` of finished runs."""
    return results.select("run_id", F.explode("stats").alias("s")).select("run_id", "s.*")
