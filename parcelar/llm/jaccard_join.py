"""Similarity self-join on word n-gram Jaccard with Bayesian candidate pruning.

1. Every text gets a MinHash signature; groups (bands) of its values are bucket keys.  With 32 bands of
   5 values a pair of similarity 0.8 shares no key with probability 3e-6, one of 0.9 with 4e-13.  A pair is
   compared if, and only if, it shares a key.  Equal texts are one node from here on, so copies never meet.
2. Texts of one bucket are tied to its smallest text, and the ties' connected components are the
   candidate groups: all pairs that share a key lie inside one.  Where a component is large but its
   buckets are small (a chain of texts that only share passages), the buckets themselves are the groups,
   and a pair counts in the first bucket that it shares; the cheaper way is chosen by counted pairs, and
   both compare the same pairs.
3. A group is cut into blocks of bounded size; each pair of blocks is a tile of its own.  A text goes to its
   tiles as its difference from the group's first text, which near copies hardly have, or as its n-grams where
   these are fewer.  In a tile the signatures of all pairs are compared a few values at a time.  After m of n
   values agreed, with a uniform prior on the similarity s, s has a Beta(m + 1, n - m + 1) posterior; a pair is
   dropped as soon as the posterior probability of s >= threshold is below the tolerance.  What is left and
   shares a key is verified with exact set intersections.  Pairs are never written out: a tile returns a
   count of links for each text and the text's cluster inside the tile.
4. Counts are summed, clusters are joined over tiles, and both go back to the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, documents, giving_back
from .components import connected_components

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
#: Posterior probability of reaching the threshold below which a pair is dropped.
TOLERANCE = 1e-6
#: Values compared between two looks at the posterior.
STEP = 32
#: Texts and bytes of n-grams in a block; a tile holds two blocks.
BLOCK_TEXTS, BLOCK_BYTES = 256, 1_000_000
#: Share of a component's pairs that its buckets may have together to be taken instead.
BUCKET_SHARE = 0.5
#: Characters whose n-grams are held at once, and words whose hashes a worker remembers.
PIECE, MEMORY = 1_000_000, 100_000

_WORDS = re.compile(r"\w+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def _seeds(count: int) -> np.ndarray:
    """Odd multipliers from a fixed rule."""
    return _mix((np.arange(count, dtype=np.uint64) + np.uint64(1)) * _M1) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngrams(texts: list[str], n: int, memory: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of the texts behind one another, and the number for each text.

    Words are lower-cased runs of word characters.  A text of fewer than n words, but not none, has one
    n-gram, its words.
    """
    hashes: list[int] = []
    words = []
    for text in texts:
        found = _WORDS.findall(text.lower())
        words.append(len(found))
        hashes.extend(map(memory.__getitem__, found))
    counts = np.array(words, np.int64)
    h = np.array(hashes, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    grams = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    place = np.repeat(starts - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    size = np.repeat(np.minimum(counts, n), grams)
    out = np.zeros(len(place), np.uint64)
    for k in range(n):
        inside = k < size
        word = np.where(inside, h[np.minimum(place + k, max(len(h) - 1, 0))], np.uint64(k)) if len(h) else out
        out = _mix(out * _M1 + word)
    return out, grams


def signatures(grams: np.ndarray, counts: np.ndarray, values: int) -> np.ndarray:
    """MinHash signatures (texts x values, 32 bits each); texts without n-grams have zeros."""
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((len(counts), values), np.uint32)
    if len(starts):
        for k, a in enumerate(_seeds(values)):
            out[full, k] = np.minimum.reduceat((grams ^ (a >> np.uint64(7))) * a, starts) >> np.uint64(32)
    return out


def bands(signature: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Bucket keys (texts x bands)."""
    grouped = signature[:, : count * rows].reshape(len(signature), count, rows)
    key = np.broadcast_to(np.arange(count, dtype=np.uint64), (len(signature), count))
    for k in range(rows):
        key = _mix(key * _M1 + grouped[:, :, k].astype(np.uint64))
    return key.view(np.int64)


def least_matches(values: int, step: int, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): after n values a pair needs m matches for the posterior to reach the tolerance.

    With a uniform prior, P(s >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(step, values + step, step):
        n = min(n, values)
        total, m = 0.0, 0
        while m <= n:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(column):
        part, held = [], 0
        while at + len(part) < len(column) and held < PIECE:
            part.append(column[at + len(part)].as_py() or "")
            held += len(part[-1])
        yield at, part
        at += len(part)


def _banded(n: int, count: int, rows: int):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            for at, part in _parts(batch["text"]):
                grams, counts = ngrams(part, n, memory)
                keys = bands(signatures(grams, counts, count * rows), count, rows)
                full = np.where(counts > 0, count, 0)
                keys = keys[counts > 0].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full)]).astype(np.int32)), pa.array(keys))
                rest = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([rest["t"], pa.array(counts), lists], names=["t", "grams", "keys"])

    return banded


def _loaded(n: int, values: int):
    """The n-gram set (sorted) and signature of each text, as bytes."""

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Hashes()
        for batch in batches:
            for at, part in _parts(batch["text"]):
                grams, counts = ngrams(part, n, memory)
                signed = signatures(grams, counts, values)
                sets = [np.unique(g).tobytes() for g in np.split(grams, np.cumsum(counts)[:-1])]
                rest = batch.slice(at, len(part))
                names = [k for k in batch.schema.names if k != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(rest[k] for k in names), pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in signed], pa.binary())],
                    names=[*names, "grams", "signature"],
                )

    return loaded


def similar(
    sets: list[Grams],
    signed: np.ndarray,
    left: np.ndarray,
    right: np.ndarray,
    threshold: float,
    looks: list[tuple[int, int]],
    chosen: Callable[[np.ndarray], np.ndarray],
) -> np.ndarray:
    """Pairs (rows of indexes a < b) between ``left`` and ``right`` that are ``chosen`` and reach ``threshold``."""
    sizes = np.array([s.size for s in sets])
    alive: list[np.ndarray] = []
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        first = looks[0][0]
        same = np.zeros((len(rows), len(right)), np.uint16)
        for k in range(first):
            same += signed[rows, k][:, None] == signed[right, k][None, :]
        i, j = np.nonzero((same >= looks[0][1]) & ((rows[:, None] < right[None, :]) if left is right else True))
        matched = same[i, j].astype(np.int32)
        i, j = rows[i], right[j]
        done = first
        for n, least in looks[1:]:
            if not len(i):
                break
            matched += (signed[i, done:n] == signed[j, done:n]).sum(axis=1, dtype=np.int32)
            good = matched >= least
            i, j, matched, done = i[good], j[good], matched[good], n
        alive.append(np.stack([i, j], axis=1))
    pairs = np.concatenate(alive) if alive else np.zeros((0, 2), np.int64)
    # The smaller set must be large enough, whatever the signatures say.
    small, large = np.minimum(sizes[pairs[:, 0]], sizes[pairs[:, 1]]), np.maximum(sizes[pairs[:, 0]], sizes[pairs[:, 1]])
    pairs = pairs[small >= threshold * large - 1e-9]
    if len(pairs):
        pairs = pairs[chosen(pairs)]
    if not len(pairs):
        return pairs
    return pairs[_jaccard(sets, sizes, pairs) >= threshold - 1e-12]


class Grams(NamedTuple):
    """The n-grams of a text, sorted: as its difference from the group's first text, or written out.

    ``less`` are the first text's n-grams that this one lacks (None: written out), ``more`` are its others (all of
    its own).  ``base`` is the number of the first text's, ``common`` of those that this one has.
    """

    size: int
    base: int
    common: int
    less: np.ndarray | None
    more: np.ndarray


def _jaccard(sets: list[Grams], sizes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Exact similarity of each pair.

    With F for the first text, two differences have |F| - |lessA| - |lessB| + |lessA n lessB| + |moreA n moreB| in
    common, a difference and a text that is written out |F n B| - |lessA n B| + |moreA n B|.
    """
    used = np.unique(pairs)
    spot = np.zeros(len(sets), np.int64)
    spot[used] = np.arange(len(used))
    own = [sets[i] for i in used.tolist()]
    left, right = spot[pairs[:, 0]], spot[pairs[:, 1]]
    more = _shared([s.more for s in own], left, right)
    near = np.array([s.less is not None for s in own])
    if near.any():
        less = _shared([s.more if s.less is None else s.less for s in own], left, right)
        common, base = np.array([s.common for s in own]), own[0].base
        two = near[left] & near[right]
        one = near[left] ^ near[right]
        written = np.where(near[left], right, left)
        both = np.where(two, common[left] + common[right] - base + less + more, np.where(one, common[written] - less + more, more))
    else:
        both = more
    return both / (sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - both)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's n-grams as the difference from its group's first text, where that is shorter."""
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for grams, first in zip(batch["grams"], batch["first"]):
            own, base = (np.frombuffer(x.as_buffer(), np.uint64) for x in (grams, first))
            common = np.intersect1d(own, base, assume_unique=True)
            less, more = np.setdiff1d(base, common, assume_unique=True), np.setdiff1d(own, common, assume_unique=True)
            near = len(less) + len(more) < len(own)
            row = (len(own), len(base), len(common), less.tobytes() if near else None, more.tobytes() if near else grams.as_py())
            for c, v in zip(columns, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = [c for c in batch.schema.names if c not in ("grams", "first")]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, columns, kinds)], names=[*names, "size", "base", "common", "less", "more"])


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the intersection of each pair of sorted sets."""
    if len(left) <= 4:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left.tolist(), right.tolist())])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column, minlength=len(grams)) > 1  # others can't be in an intersection
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(1, min(8192, 16_000_000 // max(1, len(sets))))
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], column[a:b] - lo] = 1
        common += has @ has.T
    return common[left, right].astype(np.int64)


def _clusters(count: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each item's cluster."""
    label = np.arange(count)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compared(signed: np.ndarray, bucket: int | None, count: int, rows: int) -> Callable[[np.ndarray], np.ndarray]:
    """Whether each pair is one to compare here: it shares a bucket, and ``bucket``, if given, is the first of them."""
    keys = bands(signed, count, rows)
    here = count if bucket is None else int(np.flatnonzero((keys == bucket).all(axis=0))[0])

    def chosen(pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        for lo in range(0, len(pairs), 65536):
            part = pairs[lo : lo + 65536]
            out[lo : lo + 65536] = (keys[part[:, 0], :here] == keys[part[:, 1], :here]).any(axis=1)
        return out if bucket is None else ~out

    return chosen


def _tiled(threshold: float, looks: list[tuple[int, int]], count: int, band_rows: int):
    def grams(r: dict) -> Grams:
        less = None if r["less"] is None else np.frombuffer(r["less"], np.uint64)
        return Grams(r["size"], r["base"], r["common"], less, np.frombuffer(r["more"], np.uint64))

    def settle(rows: list[dict]) -> pa.RecordBatch:
        ids = np.array([r["t"] for r in rows], np.int64)
        signed = np.stack([np.frombuffer(r["signature"], np.uint32) for r in rows])
        own = np.array([r["block"] for r in rows])
        if rows[0]["lo"] == rows[0]["hi"]:
            left = right = np.arange(len(rows))
        else:
            left, right = np.flatnonzero(own == rows[0]["lo"]), np.flatnonzero(own == rows[0]["hi"])
        chosen = _compared(signed, rows[0]["group"] if rows[0]["bucket"] else None, count, band_rows)
        pairs = similar(list(map(grams, rows)), signed, left, right, threshold, looks, chosen)
        links = np.bincount(pairs.ravel(), minlength=len(rows))
        roots = ids[_clusters(len(rows), pairs)]
        hit = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(roots[hit])], names=["t", "links", "root"])

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and any(r[c] != rows[0][c] for c in ("bucket", "group", "lo", "hi")):
                    if len(rows) > 1:
                        yield settle(rows)
                    rows = []
                if not rows or r["t"] != rows[-1]["t"]:  # rows with equal id and text bring a text twice
                    rows.append(r)
        if len(rows) > 1:
            yield settle(rows)

    return tiled


def text_classes(
    slim: DataFrame,
    threshold: float = THRESHOLD,
    n: int = N,
    n_bands: int = BANDS,
    n_rows: int = ROWS,
    tolerance: float = TOLERANCE,
    block_texts: int = BLOCK_TEXTS,
    block_bytes: int = BLOCK_BYTES,
    bucket_share: float = BUCKET_SHARE,
) -> DataFrame:
    """One row per different text of ``slim (doc_id, text, t)``: t, first, n_copies, class, n_links."""
    bounded_batches(slim.sparkSession)
    values = n_bands * n_rows
    # Written, since the buckets are counted first and then joined; copies of a text bring the same rows.
    keyed = checkpoint(slim.select("t", "text").mapInArrow(giving_back(_banded(n, n_bands, n_rows)), "t long, grams long, keys array<long>").where("grams > 0"))
    spread = keyed.select("t", "grams", F.explode("keys").alias("key"))
    # Copies of a text bring the same (key, t) pairs, which combine before the shuffle.
    bucket = checkpoint(spread.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("key", "low"))
    # Copies have been combined here: a row per bucket and different text.
    shared = checkpoint(spread.join(bucket, "key").groupBy("key", "t").agg(F.max("grams").alias("grams"), F.max("low").alias("low")))
    roots = connected_components(shared.select(F.col("t").alias("u"), F.col("low").alias("v")))
    group = F.coalesce("root", "t").alias("group")
    sized = shared.groupBy("t").agg(F.max("grams").alias("grams"))
    grouped = sized.join(roots.withColumnRenamed("node", "t"), "t", "left").select("t", "grams", group)
    buckets = shared.groupBy("key", F.col("low").alias("t")).agg(F.count("*").alias("texts"), F.sum("grams").alias("grams"))
    bucket_pairs = buckets.join(roots.withColumnRenamed("node", "t"), "t", "left").groupBy(group).agg(F.sum(F.col("texts") * F.col("texts")).alias("pairs"))
    groups = grouped.groupBy("group").agg(F.count("*").alias("texts"), F.sum("grams").alias("grams")).where("texts > 1").join(bucket_pairs, "group")
    by_bucket = (F.col("texts") > block_texts) & (F.col("pairs") < F.col("texts") * F.col("texts") * bucket_share)
    blocks = F.ceil(F.greatest(F.col("texts") / block_texts, F.col("grams") * 8 / block_bytes)).cast("int").alias("blocks")
    groups = checkpoint(groups.select("group", blocks, by_bucket.alias("bucket")))
    members = grouped.drop("grams").join(groups, "group")
    in_buckets = (
        shared.drop("low")
        .join(members.where("bucket").select("t"), "t")
        .join(checkpoint(buckets.select("key", blocks, F.col("t").alias("base"))), "key")
        .select("t", F.col("key").alias("group"), "blocks", F.lit(True).alias("bucket"), "base")
    )
    # A component is named by its smallest text, which is the one that others differ from; so is a bucket's.
    members = members.where("NOT bucket").select("t", "group", "blocks", "bucket", F.col("group").alias("base")).unionByName(in_buckets)
    # One document stands for each text: the first by id.
    first = slim.groupBy("t").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    own_groups = F.collect_set(F.struct("group", "blocks", "bucket", "base")).alias("groups")  # one, or one per bucket at most
    chosen = members.join(first, "t").groupBy("t", "first").agg(own_groups)
    sources = (
        slim.alias("a")
        .join(chosen.alias("b"), (F.col("a.t") == F.col("b.t")) & F.col("a.doc_id").eqNullSafe(F.col("b.first")))
        .select("a.t", "a.text", "b.groups")
    )
    kind = "array<struct<group:bigint,blocks:int,bucket:boolean,base:bigint>>"
    loaded = checkpoint(sources.mapInArrow(giving_back(_loaded(n, values)), f"t long, groups {kind}, grams binary, signature binary"))
    placed = loaded.select("t", "grams", "signature", F.inline("groups"))
    none = F.lit(0).cast("long")
    alone = placed.where("blocks = 1").select(
        "t", "signature", "group", "blocks", "bucket", (F.octet_length("grams") / 8).cast("long").alias("size"),
        none.alias("base"), none.alias("common"), F.lit(None).cast("binary").alias("less"), F.col("grams").alias("more"),
    )
    bases = loaded.where("exists(groups, g -> g.base = t AND g.blocks > 1)").select(F.col("t").alias("base"), F.col("grams").alias("first"))
    split = (
        placed.where("blocks > 1")
        .join(bases, "base")
        .select("t", "signature", "group", "blocks", "bucket", "grams", "first")
        .mapInArrow(giving_back(_differ), "t long, signature binary, group long, blocks int, bucket boolean, size long, base long, common long, less binary, more binary")
    )
    spans = (
        alone.unionByName(split)
        .withColumn("block", F.expr("cast(pmod(xxhash64(t, 1), blocks) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    )
    tiles = (
        spans.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .select("bucket", "group", "lo", "hi", "block", "t", "size", "base", "common", "less", "more", "signature")
        .repartition("bucket", "group", "lo", "hi")
        .sortWithinPartitions("bucket", "group", "lo", "hi", "t")
        .mapInArrow(giving_back(_tiled(threshold, least_matches(values, STEP, threshold, tolerance), n_bands, n_rows)), "t long, links long, root long")
    )
    linked = checkpoint(tiles.groupBy("t", "root").agg(F.sum("links").alias("links")))
    classes = connected_components(linked.select(F.col("t").alias("u"), F.col("root").alias("v")))
    links = linked.groupBy("t").agg(F.sum("links").alias("n_links"))
    return (
        first.join(classes.withColumnRenamed("node", "t"), "t", "left")
        .join(links, "t", "left")
        .select("t", "first", "n_copies", F.coalesce("root", "t").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return slim.withColumn("t", F.xxhash64("text"))


def jaccard_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document row: doc_id, class_id, n_links, n_copies.

    ``n_links`` counts the *other texts* whose n-gram sets have a Jaccard similarity of ``threshold`` or
    more with this one; ``n_copies`` counts the rows with this same text, itself included.  ``class_id``
    is the smallest doc_id among all documents tied by copies and links, directly or through others.
    Options are those of :func:`text_classes`.

    Texts are told apart by a 64-bit hash.  A null text counts as empty; a text without words links to
    nothing, but equal texts are copies all the same; a null id stays null and is the class id only where
    all ids of a class are null; repeated rows each keep a row; an empty table gives an empty table; other
    columns are ignored, whatever their names.
    """
    slim = _slim(docs, doc_id, text)
    texts = text_classes(slim, **options)
    named = texts.groupBy("class").agg(F.min("first").alias("class_id"))
    return (
        slim.select("doc_id", "t")
        .join(texts.join(named, "class").select("t", "class_id", "n_links", "n_copies"), "t")
        .select("doc_id", "class_id", "n_links", "n_copies")
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of ``documents`` for each class of :func:`jaccard_links`, with its columns.

    The row with the smallest id stays (of rows that share it, the one with the smallest text hash); a
    class without any id keeps one row too.  Rows with equal id and text are combined before the shuffle.
    """
    texts = text_classes(_slim(docs, "doc_id", "text"), **options)
    best = texts.groupBy("class").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "t")).alias("w"))
    winners = best.select(F.xxhash64("w.first", "w.t").alias("k"))
    key = F.xxhash64(F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).alias("k")
    rows = docs.select(key, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row")).dropDuplicates(["k"])
    return rows.join(winners, "k", "left_semi").select("row.*")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(documents(spark, sf_dir))


#: All pairs by way of shared n-grams, then components by recursion; for small tables.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT text, min(doc_id) AS first, count(*) AS n_copies FROM d GROUP BY text
), w AS (
  SELECT first, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM t
), g AS (
  SELECT DISTINCT first, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT first, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT first, count(*) AS n FROM g GROUP BY first
), shared AS (
  SELECT a.first AS a, b.first AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.first <> b.first GROUP BY a.first, b.first
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.first = a JOIN n y ON y.first = b WHERE c / (x.n + y.n - c) >= 0.8 - 1e-12
), reach(a, b) AS (
  SELECT first, first FROM t
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), classes AS (
  SELECT a AS first, min(b) AS class_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS first, count(*) AS n_links FROM links GROUP BY a
)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies
FROM d JOIN t USING (text) JOIN classes USING (first) LEFT JOIN counts USING (first)
"""
