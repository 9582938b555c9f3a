"""Comparison of heuristics over long results ``id, heuristic, f, time_s``.

A missing value is null or NaN: it has no rank and counts in no mean.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Decimal places to which values are rounded before ranks and wins, and before the Friedman test.
RANK_PLACES, TEST_PLACES = 8, 5


def present(results: DataFrame, metric: str) -> DataFrame:
    """``id, heuristic, value`` of the rows that have the metric."""
    rows = results.select("id", "heuristic", F.col(metric).cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def mean_values(results: DataFrame, metric: str = "f") -> DataFrame:
    return present(results, metric).groupBy("heuristic").agg(F.avg("value").alias("mean"))


def ranks(results: DataFrame, metric: str = "f", places: int = RANK_PLACES) -> DataFrame:
    """``id, heuristic, value, rank``: from 1 inside each id, ascending, ties averaged."""
    rounded = present(results, metric).withColumn("value", F.bround("value", places))
    order, tied = Window.partitionBy("id").orderBy("value"), Window.partitionBy("id", "value")
    return rounded.withColumn("rank", F.rank().over(order) + (F.count("*").over(tied) - 1) / 2)


def wins(results: DataFrame, metric: str = "f") -> DataFrame:
    """``heuristic, wins``: ids in which it has the lowest rank; all that tie there win."""
    best = ranks(results, metric).withColumn("best", F.min("rank").over(Window.partitionBy("id")))
    return best.groupBy("heuristic").agg(F.count_if(F.col("rank") == F.col("best")).alias("wins"))


def summary(results: DataFrame, metric: str = "f") -> DataFrame:
    """``heuristic, mean_f, mean_rank, wins``, by mean rank."""
    best = ranks(results, metric).withColumn("best", F.min("rank").over(Window.partitionBy("id")))
    table = best.groupBy("heuristic").agg(F.avg("rank").alias("mean_rank"), F.count_if(F.col("rank") == F.col("best")).alias("wins"))
    means = mean_values(results, metric).withColumnRenamed("mean", "mean_f")
    return table.join(means, "heuristic").select("heuristic", "mean_f", "mean_rank", "wins").orderBy("mean_rank", "heuristic")


def complete(results: DataFrame, metric: str) -> DataFrame:
    """Rows of the ids that have a value for every heuristic of the table."""
    rows = present(results, metric)
    number = rows.agg(F.count_distinct("heuristic").alias("k"))
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("id")))
    return counted.join(F.broadcast(number), F.col("_n") == F.col("k")).select("id", "heuristic", F.col("value").alias(metric), "k")


def friedman(results: DataFrame, metric: str = "f") -> DataFrame:
    """One row: n (ids), k (heuristics), statistic, p.

    Tie-corrected chi-square over ids with all values; null where all values tie, where there are fewer
    than three heuristics, or without ids.
    """
    rows = complete(results, metric)
    ranked = ranks(rows.select("id", "heuristic", metric), metric, TEST_PLACES)
    sums = ranked.groupBy("heuristic").agg(F.sum("rank").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    ties = ranked.groupBy("id", "value").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    size = ranked.agg(F.count_distinct("id").alias("n"), F.count_distinct("heuristic").alias("k"))
    one = size.join(sums, how="cross").join(ties, how="cross")  # three tables of one row each
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    raw = 12 / (n * k * (k + 1)) * F.col("s2") - 3 * n * (k + 1)
    statistic = F.when((F.col("k") >= 3) & (F.col("n") > 0) & (correction > 1e-12), raw / correction)
    return one.select("n", "k", statistic.alias("statistic")).withColumn("p", chi_square_tail(F.col("statistic"), F.col("k") - 1))


def chi_square_tail(x: Column, freedom: Column) -> Column:
    """Probability that chi-square exceeds ``x``: a finite sum for each parity of the degrees of freedom."""

    def tail(values: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series([_chi_square_tail(v, int(d)) for v, d in zip(values, degrees)], dtype="float64")

    return F.pandas_udf(tail, T.DoubleType())(x, freedom)


def _chi_square_tail(x: float, freedom: int) -> float | None:
    if x is None or math.isnan(x) or freedom < 1:
        return None
    half = max(0.0, x) / 2
    if freedom % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = math.erfc(math.sqrt(half)), math.sqrt(half / math.pi) * 2 * math.exp(-half)
    for i in range(1, (freedom + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


def studentized_range_tail(q: float, k: int) -> float:
    """Probability that the range of k standard normal variables exceeds ``q``, by the trapezoid rule."""
    z = np.linspace(-8.5, 8.5 + q, 40_001)
    normal = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    below = np.concatenate([[0.0], np.cumsum((normal[1:] + normal[:-1]) / 2 * np.diff(z))])
    inside = (below - np.interp(z - q, z, below, left=0.0)) ** (k - 1)
    return float(min(1.0, max(0.0, 1 - k * np.trapezoid(normal * inside, z))))


def mean_ranks(results: DataFrame, metric: str = "f") -> DataFrame:
    """``heuristic, mean_rank, n, k`` over ids with all values."""
    rows = complete(results, metric)
    ranked = ranks(rows.select("id", "heuristic", metric), metric, TEST_PLACES)
    return ranked.groupBy("heuristic").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n")).withColumn("k", F.count("*").over(Window.partitionBy(F.lit(0))))


def nemenyi(results: DataFrame, metric: str = "f", alpha: float = 0.05) -> DataFrame:
    """``a, b, q, p, level`` for pairs a < b of heuristics; no rows unless the Friedman test is significant.

    The level is '***', '**', '*' or 'ns' at 0.001, 0.01 and 0.05.
    """
    table = mean_ranks(results, metric)
    other = table.select(F.col("heuristic").alias("b"), F.col("mean_rank").alias("rank_b"))
    pairs = table.join(other, F.col("heuristic") < F.col("b"))  # a row per heuristic on either side
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    pairs = pairs.select(F.col("heuristic").alias("a"), "b", (F.abs(F.col("mean_rank") - F.col("rank_b")) / F.sqrt(k * (k + 1) / (6 * n))).alias("q"), F.col("k").alias("_k"))

    def tail(q: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([studentized_range_tail(v * math.sqrt(2), int(c)) for v, c in zip(q, k)], dtype="float64")

    p = F.pandas_udf(tail, T.DoubleType())("q", "_k")
    level = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    opened = friedman(results, metric).where(F.col("p") < alpha).select(F.lit(1).alias("_open"))
    return pairs.withColumn("p", p).withColumn("level", level).join(F.broadcast(opened), how="cross").select("a", "b", "q", "p", "level")


def critical_difference(results: DataFrame, metric: str = "f", alpha: float = 0.05) -> DataFrame:
    """Data behind the diagram: ``a, rank_a, b, rank_b`` for pairs that don't differ significantly."""
    table = mean_ranks(results, metric).select("heuristic", "mean_rank")
    same = nemenyi(results, metric, alpha).where(F.col("p") >= alpha)
    return (
        same.join(table.select(F.col("heuristic").alias("a"), F.col("mean_rank").alias("rank_a")), "a")
        .join(table.select(F.col("heuristic").alias("b"), F.col("mean_rank").alias("rank_b")), "b")
        .select("a", "rank_a", "b", "rank_b")
    )


def boxplot(results: DataFrame, metric: str = "f") -> DataFrame:
    """``heuristic, q1, median, q3, low, high, outliers``: quartiles, whiskers at 1.5 ranges, values beyond."""
    rows = present(results, metric)
    box = rows.groupBy("heuristic").agg(*(F.percentile("value", F.lit(q)).alias(c) for q, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("value") >= F.col("q1") - reach) & (F.col("value") <= F.col("q3") + reach)
    joined = rows.join(F.broadcast(box), "heuristic")  # a row per heuristic
    return joined.groupBy("heuristic", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high"), F.count_if(~inside).alias("outliers")
    )


def analyse(results: DataFrame, heuristics: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a comparison of some heuristics, or of all; empty results give no tables."""
    rows = results.where(F.col("heuristic").isin(heuristics)) if heuristics else results
    number = rows.agg(F.count_distinct("heuristic")).first()[0]
    if not number:
        return {}
    tables = {"summary": summary(rows), "boxplot_f": boxplot(rows, "f"), "boxplot_time": boxplot(rows, "time_s")}
    if number >= 3:
        for metric in ("f", "time_s"):
            tables |= {f"friedman_{metric}": friedman(rows, metric), f"nemenyi_{metric}": nemenyi(rows, metric), f"critical_{metric}": critical_difference(rows, metric)}
    return tables
