"""Byte-balanced contiguous sharding, DataFrame operations only.

Rows are ordered by ``(doc_id, text checksum, size)``.  Range partitions give every row a place in
that order; per-partition totals (one row a partition) become prefix sums; a row's global byte
offset is its partition's prefix plus its running sum inside the partition.  Cutting the offsets at
equal targets gives contiguous shards whose byte totals differ by less than one row.

Only ``(id, size, checksum)`` is shuffled, never the text.  The text is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, documents, shuffle_partitions

SHARDS = 8


def shard_by_bytes(
    docs: DataFrame, n_shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 1 and checksum 0; a null id sorts first; repeated rows each keep a row of
    their own; an empty table gives an empty table; other columns are ignored, whatever their names.
    ``grown_shard`` is null, since this law moves rows when the shard count changes.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )
    # Equal rows are told apart by where they were read, so that no range holds all copies of a row.
    slim = slim.withColumn("_tie", F.monotonically_increasing_id())
    order = ["doc_id", "text_crc32", "size", "_tie"]
    # The range bounds are sampled anew in each run of a plan, so they are fixed by a checkpoint.
    ranged = checkpoint(
        slim.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    )
    parts = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    everything = Window.partitionBy(F.lit(0))
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("_end", F.sum("size").over(inside))
        .withColumn("_nth", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(parts), "_part")
        .withColumn("_twice_middle", 2 * (F.col("_bytes_before") + F.col("_end")) - F.col("size"))
        .withColumn(
            "shard",
            F.least(F.lit(n_shards - 1), F.expr(f"_twice_middle * {n_shards} div (2 * _total)")).cast("int"),
        )
        .withColumn("_index", F.col("_rows_before") + F.col("_nth") - 1)
    )
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_index") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


#: CRC-32 over the UTF-8 bytes: the table follows from the reflected polynomial 0xEDB88320.
SQL = """
WITH RECURSIVE bits(i, c, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size FROM documents
), h AS (
  SELECT doc_id, size,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ('0x' || x)::BIGINT)),
           lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32
  FROM d, crc_table
), o AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         sum(size) OVER ()::BIGINT AS total,
         row_number() OVER (ORDER BY doc_id, text_crc32, size) AS nth
  FROM h
), s AS (
  SELECT *, least(7, ((2 * upto - size) * 8) // (2 * total))::INTEGER AS shard FROM o
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       nth - min(nth) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
