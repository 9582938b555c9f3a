"""Benchmark decontamination by winnowing, DataFrame operations only.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lowered.  A window is ten
consecutive words of a benchmark item; an item of one to nine words is a single window.

Winnowing with k = 5 and w = 6: the word 5-grams of a text are hashed, and each ten-word span keeps
the smallest of its six hashes, so any two equal spans keep the same fingerprint.  Runs of spans with
one fingerprint become one row.  Document fingerprints join with the benchmark's; each hit is extended
to the spans that its run can hold, and those are compared with the benchmark's windows by hash and
word by word.  Items shorter than a window have no such guarantee, so their single windows are
fingerprints themselves and every run of that many document words is looked up.

While the benchmark's windows are few enough to be broadcast (a counted bound), the documents are read and
split once and their words are never shuffled.  Beyond it the same joins run shuffled, carrying only the words
around a fingerprint, and frequent fingerprints meet the benchmark's in ``SALTS`` parts; documents without a
hit take no part in the joins and are added by an aggregate.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

WINDOW = 10
GRAM = 5
#: Benchmark windows (under 300 bytes each) up to which they are broadcast.
BROADCAST_WINDOWS = 200_000
#: Parts into which the documents' rows of one fingerprint or window are dealt where these are shuffled.
SALTS = 16

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Words of a text; a null gives none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _SEPARATORS, _UPPER.lower() + " " * len(_SEPARATORS))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _hashes(words: str, n: int) -> str:
    """SQL: the hash of each run of ``n`` words, in order."""
    return (
        f"IF(size({words}) < {n}, cast(array() AS array<bigint>), "
        f"transform(sequence(1, size({words}) - {n - 1}), i -> xxhash64(slice({words}, i, {n}))))"
    )


def _fingerprints(hashes: str, w: int) -> str:
    """SQL: the smallest of each ``w`` consecutive hashes."""
    return (
        f"IF(size({hashes}) < {w}, cast(array() AS array<bigint>), "
        f"transform(sequence(1, size({hashes}) - {w - 1}), i -> array_min(slice({hashes}, i, {w}))))"
    )


def benchmark_windows(
    benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per distinct window: n (words), phrase, hash, fp (fingerprint), items (distinct ids)."""
    fp = F.array_min(F.expr(_hashes("w", gram)))
    return (
        benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("n", F.least(F.lit(window), F.size("words")))
        .select("item", "n", F.explode(F.expr("transform(sequence(1, size(words) - n + 1), i -> slice(words, i, n))")).alias("w"))
        .select(
            "item",
            "n",
            F.array_join("w", " ").alias("phrase"),
            F.xxhash64("w").alias("hash"),
            F.when(F.col("n") == window, fp).otherwise(F.xxhash64("w")).alias("fp"),
        )
        .groupBy("n", "phrase", "hash", "fp")
        .agg(F.collect_set("item").alias("items"))
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts words inside any occurrence of a benchmark window.  A null or empty text has no
    words; null ids stay null; repeated rows each keep a row; an item without words matches nothing,
    an item id that is null counts as the empty string and repeated item ids count once; empty tables
    give no rows or no hits; other columns are ignored, whatever their names.
    """
    w = window - gram + 1
    known = benchmark_windows(benchmark, item_id, item_text, window, gram)
    sizes = {r["n"]: r["count"] for r in known.groupBy("n").count().collect()}  # at most `window` rows
    small = sum(sizes.values()) <= broadcast_windows

    def meet(some: DataFrame, few: DataFrame, names: tuple[str, ...]) -> DataFrame:
        """Join with benchmark rows, whose columns begin with a mark, on equal values of ``names``."""
        on = [F.col(c) == F.col(f"_{c}") for c in names]
        if small:
            few = F.broadcast(few)
        else:
            some = some.withColumn("salt", F.expr(f"cast(pmod(xxhash64(k1, at), {SALTS}) AS int)"))
            few = few.withColumn("_salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
            on.append(F.col("salt") == F.col("_salt"))
        # Rows that stand for a document (n = 0) are never shuffled here: there are none beside shuffled hits.
        return some.join(few, on, "left" if small else "inner")

    # Equal rows share a key and are counted, so that no position of a row has to be the same in every attempt.
    split = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"),
        F.xxhash64(F.lit("second"), F.col(text), F.col(doc_id)).alias("k2"),
        words_of(F.col(text)).alias("words"),
    )
    key = ["doc_id", "k1", "k2"]
    # A fingerprint per run of spans: runs start where the value changes, and every w spans at the latest.
    runs = (
        "transform(filter(transform(_fps, (f, j) -> struct(j + 1 AS at, "
        f"{window} AS n, f AS fp, j = 0 OR j % {w} = 0 OR f <> _fps[greatest(j - 1, 0)] AS first)), s -> s.first), "
        "s -> struct(s.at AS at, s.n AS n, s.fp AS fp))"
    )
    found = split.withColumn("_hashes", F.expr(_hashes("words", gram)))
    found = found.withColumn("_fps", F.expr(_fingerprints("_hashes", w)))
    parts = ["cast(array() AS array<struct<at:int,n:int,fp:bigint>>)"]
    if small:
        parts.append("array(struct(0 AS at, 0 AS n, cast(null AS bigint) AS fp))")  # one row that stands for the document
    if window in sizes:
        parts.append(runs)
    parts += [
        f"transform({_hashes('words', n)}, (h, j) -> struct(j + 1 AS at, {n} AS n, h AS fp))"
        for n in sorted(sizes)
        if n < window
    ]
    looked_up = found.select(*key, "words", F.explode(F.expr(f"concat({', '.join(parts)})")).alias("c"))
    if small:
        looked_up = looked_up.select(*key, F.when(F.col("c.n") == 0, F.size("words")).alias("n_words"), "words", F.lit(1).alias("base"), "c.*")
    else:  # shuffled: only the words that the spans of the run can reach
        around = F.expr(f"slice(words, c.at, {window + w - 1})")
        looked_up = looked_up.select(*key, F.lit(None).cast("int").alias("n_words"), around.alias("words"), F.col("c.at").alias("base"), "c.*")
    prints = known.select(F.col("n").alias("_n"), F.col("fp").alias("_fp")).distinct()
    hits = meet(looked_up, prints, ("fp", "n")).where((F.col("n") == 0) | F.col("_fp").isNotNull())
    last = f"CASE WHEN n = 0 THEN at WHEN n < {window} THEN at ELSE least(at + {w - 1}, base + size(words) - {window}) END"
    spans = (
        hits.select(*key, "n_words", "words", "base", "n", F.explode(F.expr(f"sequence(at, {last})")).alias("at"))
        .withColumn("_span", F.expr("IF(n = 0, cast(array() AS array<string>), slice(words, at - base + 1, n))"))
        .select(*key, "n_words", "n", "at", F.xxhash64("_span").alias("hash"), F.array_join("_span", " ").alias("phrase"))
    )
    names = known.select(F.col("hash").alias("_hash"), F.col("phrase").alias("_phrase"), "items")
    matched = meet(spans, names, ("hash", "phrase")).where((F.col("n") == 0) | F.col("items").isNotNull())
    matched = matched.select(*key, "n_words", "n", "at", "items")
    if not small:
        nothing = [F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("items")]
        matched = matched.unionByName(split.select(*key, F.size("words").alias("n_words"), *nothing))
    covered = (
        "aggregate(array_sort(_spans), struct(0 AS upto, 0L AS total), (a, s) -> struct("
        "greatest(a.upto, s.at + s.n) AS upto, a.total + greatest(0, s.at + s.n - greatest(a.upto, s.at)) AS total), a -> a.total)"
    )
    return (
        matched.groupBy(*key)
        .agg(
            F.max("n_words").cast("long").alias("n_words"),
            F.count_if(F.col("n") == 0).alias("_rows"),
            F.collect_set(F.when(F.col("n") > 0, F.struct("at", "n"))).alias("_spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("_items"),
        )
        .select("doc_id", "n_words", F.expr(covered).alias("n_hit"), "_items", F.explode(F.expr("sequence(1, _rows)")).alias("_nth"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` without any benchmark window, with their columns.

    Only the hits are joined back, by id and text hash, so that equal rows share a verdict.
    """
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(F.struct("doc_id", key.alias("k1")).alias("doc_id"), "text")
    hit = decontaminate(keyed, benchmark, **options).where("contaminated").select("doc_id.*").distinct()
    on = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("a.doc_id", "a.text") == F.col("b.k1"))
    return docs.alias("a").join(hit.alias("b"), on, "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS uid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), spans AS (
  SELECT uid, n, pos, array_to_string(w[pos:pos + n - 1], ' ') AS phrase
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM dw, lengths)
), hits AS (
  SELECT uid, pos, s.n, item_id FROM spans s JOIN windows b ON s.n = b.n AND s.phrase = b.phrase
), words AS (
  SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY uid
), items AS (
  SELECT uid, list_sort(list(DISTINCT item_id)) AS ids FROM hits GROUP BY uid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""
