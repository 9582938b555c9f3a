"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments.  If two codes differ in at most m * (s + 1) - 1 bits, some segment differs
in at most s.  So round s looks up, for every segment, all values at a distance of exactly s from the
query's; found codes are verified by their whole Hamming distance.  A query is finished as soon as k
neighbours within m * (s + 1) - 1 bits are known, since nothing that is still unseen can be nearer.

Equal codes are one entry of the index, with their k smallest ids, and equal queries one query, so a
common vector costs no more than a rare one.  The index is grouped by segment and the high bits of its
value; a probe goes to the groups at a high-bit distance a <= s and looks for the low bits at distance
s - a there: by enumerating them, or, where they are more than the group's entries, by comparing those.
Groups beyond a bound are split by a hash of the code, and their probes go to each part.  The high-bit
moves are a table of 2^16 rows at most, which is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint

K = 10
#: High bits of a segment that name its group, by the width of a segment.
HIGH = {16: 8, 32: 16}
#: Index entries of a group part at most (about), and rows that are searched at once.
GROUP, CHUNK = 20_000, 60_000
#: Vectors from which segments have 32 bits and not 16, so that a looked-up value has few entries; either is exact.
WIDE = 1 << 22


def sign_code(vector: Column, bits: int, width: int) -> Column:
    """Code of a vector: bit i says whether component i is positive; an array of segments of ``width`` bits.

    Null for a null vector, one of another length, and one with null components.
    """
    signs = [F.when(vector[i] > 0, F.lit(1 << (i % width)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(bits)]
    segments = []
    for lo in range(0, bits, width):
        total = signs[lo]
        for s in signs[lo + 1 : lo + width]:
            total = total + s
        segments.append(total)
    return F.when((F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull()), F.array(*segments))


def _masks(width: int, distance: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``distance`` are set."""
    out = np.zeros(0 if distance else 1, np.int64)
    if distance:
        out = np.fromiter((sum(1 << b for b in bits) for bits in combinations(range(width), distance)), np.int64)
    return out


def _probe(k: int, low: int):
    masks: dict[int, np.ndarray] = {}

    def mask(distance: int) -> np.ndarray:
        if distance not in masks:
            masks[distance] = _masks(low, distance)
        return masks[distance]

    def search(table: dict[str, np.ndarray], codes: np.ndarray) -> pa.RecordBatch:
        """Index entries (rest < 0) and probes of whole groups together."""
        entry = np.flatnonzero(table["rest"] < 0)
        probe = np.flatnonzero(table["rest"] >= 0)
        group = np.cumsum(table["start"]) << low
        rows = np.arange(len(group))
        key = group + (codes[rows, table["j"]] & ((1 << low) - 1))
        sorted_entry = entry[np.argsort(key[entry], kind="stable")]
        keys = key[sorted_entry]
        begin, end = np.searchsorted(keys, group, "left"), np.searchsorted(keys, group + (1 << low), "left")
        found: list[np.ndarray] = []

        def verify(part: np.ndarray, a: np.ndarray, n: np.ndarray) -> None:
            """Compares each of ``part`` with the ``n`` sorted entries from ``a`` on."""
            upto = np.cumsum(n)
            for lo, hi in _cuts(upto, 500_000):
                m = n[lo:hi]
                who = np.repeat(part[lo:hi], m)
                other = sorted_entry[np.repeat(a[lo:hi] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                distance = np.bitwise_count(codes[who] ^ codes[other]).sum(axis=1, dtype=np.int64)
                found.append(_best(codes, table["first"], who, other, distance, k))

        for d in np.unique(table["rest"][probe]).tolist():
            mine = probe[table["rest"][probe] == d]
            size = end[mine] - begin[mine]
            enumerated = comb(low, d) <= size
            rest = mine[~enumerated]
            verify(rest, begin[rest], size[~enumerated])  # a few entries too far in this segment do no harm
            mine = mine[enumerated]
            step = max(1, 500_000 // comb(low, d))
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                wanted = (key[part][:, None] ^ mask(d)[None, :]).ravel()
                a = np.searchsorted(keys, wanted, "left")
                n = np.searchsorted(keys, wanted, "right") - a
                hit = n > 0
                verify(np.repeat(part, len(mask(d)))[hit], a[hit], n[hit])
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        pairs = _best(codes, table["first"], pairs[:, 0], pairs[:, 1], pairs[:, 2], k)
        who, other = pairs[:, 0], pairs[:, 1]
        m = codes.shape[1]

        def lists(rows):
            return pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(rows) + 1, m, dtype=np.int32)), pa.array(codes[rows].ravel()))

        return pa.RecordBatch.from_arrays(
            [lists(who), lists(other), pa.array(table["first"][other]), pa.array(table["n"][other]), pa.array(pairs[:, 2].astype(np.int32))],
            names=["query", "code", "first", "n", "distance"],
        )

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def take(upto: pa.Table):
            column = {c: upto[c].to_numpy() for c in ("j", "hi", "part", "rest", "first", "n")}
            codes = upto["code"].combine_chunks()
            codes = codes.flatten().to_numpy().reshape(len(codes), -1)
            edge = np.ones(len(codes), np.int64)
            edge[1:] = (column["j"][1:] != column["j"][:-1]) | (column["hi"][1:] != column["hi"][:-1]) | (column["part"][1:] != column["part"][:-1])
            return column | {"start": edge}, codes

        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= CHUNK:
                whole = pa.Table.from_batches(held)
                column, codes = take(whole)
                last = int(np.flatnonzero(column["start"])[-1])  # the last group may go on
                if last:
                    yield search({k: v[:last] for k, v in column.items()}, codes[:last])
                held, rows = whole.slice(last).to_batches(), len(whole) - last
        if rows:
            yield search(*take(pa.Table.from_batches(held)))

    return probed


def _cuts(upto: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges whose running total grows by ``size`` at most, or single items."""
    i = 0
    while i < len(upto):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


def _best(codes: np.ndarray, first: np.ndarray, who: np.ndarray, other: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """The k nearest different codes of each query, by (distance, smallest id)."""
    if not len(who):
        return np.zeros((0, 3), np.int64)
    asked = np.unique(codes[who], axis=0, return_inverse=True)[1].ravel()
    order = np.lexsort((first[other], distance, asked))
    asked, who, other, distance = asked[order], who[order], other[order], distance[order]
    fresh = np.ones(len(who), bool)  # the same entry may be reached through several segments
    fresh[1:] = (asked[1:] != asked[:-1]) | (first[other[1:]] != first[other[:-1]]) | (codes[other[1:]] != codes[other[:-1]]).any(axis=1)
    asked, who, other, distance = asked[fresh], who[fresh], other[fresh], distance[fresh]
    begin = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
    nth = np.arange(len(asked)) - np.repeat(begin, np.diff(np.append(begin, len(asked))))
    return np.stack([who, other, distance], axis=1)[nth < k]


def hamming_top_k(entries: DataFrame, queries: DataFrame, bits: int, width: int, k: int = K, group: int = GROUP) -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance of the k nearest entries, by (distance, id).

    ``entries (id long, code)`` and ``queries (id long, code)`` have codes as arrays of segments.  Rows
    with a null id or code are left out; repeated rows count once; an id with several codes is an entry
    for each; fewer than k entries give fewer neighbours; a query that is an entry too finds itself; empty
    tables give no rows.
    """
    spark = entries.sparkSession
    bounded_batches(spark)
    m = -(-bits // width)
    high = HIGH.get(width, max(1, width // 2))
    low = width - high
    entries = entries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    queries = queries.where("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    # Only k ids of a code can matter; the limit is taken before the shuffle as well.
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = entries.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    index = checkpoint(kept.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    spread = index.select("code", F.col("ids")[0].alias("first"), F.size("ids").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    spread = spread.withColumn("hi", F.shiftright(F.col("code")[F.col("j")], low))
    sizes = checkpoint(spread.groupBy("j", "hi").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")))
    placed = spread.join(sizes, ["j", "hi"]).select(
        "j", "hi", F.expr("cast(pmod(xxhash64(code), parts) AS int)").alias("part"), F.lit(-1).alias("rest"), "code", "first", "n"
    )
    open_queries = checkpoint(queries.select(F.col("code").alias("query")).distinct())
    best = spark.createDataFrame([], "query array<bigint>, code array<bigint>, first bigint, n int, distance int")
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("distance", "first", "code"))
    for s in range(width + 1):
        moves = [(int(x), s - a) for a in range(max(0, s - low), min(high, s) + 1) for x in _masks(high, a)]
        if not moves:
            break
        table = pd.DataFrame([(j, x, r) for x, r in moves for j in range(m)], columns=["j", "mask", "rest"])  # 2^high * m rows at most
        move = F.broadcast(spark.createDataFrame(table, "j int, mask long, rest int"))
        asked = (
            open_queries.select("query", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
            .join(move, "j")
            .select("query", "j", F.shiftright(F.col("query")[F.col("j")], low).bitwiseXOR(F.col("mask")).alias("hi"), "rest")
            .join(sizes, ["j", "hi"])
            .select("j", "hi", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "rest", F.col("query").alias("code"), F.lit(0).cast("long").alias("first"), F.lit(0).alias("n"))
        )
        found = (
            placed.unionByName(asked)
            .repartition("j", "hi", "part")
            .sortWithinPartitions("j", "hi", "part")
            .mapInArrow(_probe(k, low), "query array<bigint>, code array<bigint>, first long, n int, distance int")
        )
        # Codes found before come again only through other segments.
        both = best.unionByName(found).groupBy("query", "code").agg(F.min("first").alias("first"), F.min("n").alias("n"), F.min("distance").alias("distance"))
        best = checkpoint(both.withColumn("nth", nearest).where(F.col("nth") <= k).drop("nth"))
        covered = m * (s + 1) - 1
        done = best.where(F.col("distance") <= covered).groupBy("query").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        open_queries = checkpoint(open_queries.join(done, "query", "left_anti"))
        if open_queries.isEmpty():
            break
    named = best.select("query", "code", "distance").join(index, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))
    top = named.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(queries.withColumnRenamed("code", "query"), "query").select(F.col("id").alias("query_id"), "rank", "neighbour_id", "distance")


def top_k_vectors(vectors: DataFrame, queries: DataFrame, bits: int, k: int = K, id: str = "vec_id", vector: str = "embedding", wide: int = WIDE) -> DataFrame:
    """:func:`hamming_top_k` over the sign codes of vectors of ``bits`` components."""
    width = 16 if vectors.count() < wide else 32
    coded = lambda df: df.select(F.col(id).cast("long").alias("id"), sign_code(F.col(vector), bits, width).alias("code"))
    return hamming_top_k(coded(vectors), coded(queries), bits, width, k)


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k_vectors(vectors, vectors.where("vec_id % 100 = 0"), bits=64)


SQL = """
WITH e AS (
  SELECT vec_id, [x > 0 FOR x IN embedding] AS bits FROM embeddings
), d AS (
  SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
         list_sum([(q.bits[i] <> e.bits[i])::INTEGER FOR i IN range(1, 65)])::INTEGER AS distance
  FROM e q, e WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM d
)
SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10
"""
