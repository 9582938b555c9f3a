"""Removal of long repeated byte strings by longest-previous-factor arrays.

A byte goes if some string of ``length`` bytes that covers it also starts elsewhere: at an earlier
place (``keep="first"``) or at any other place (``keep="none"``).  One suffix array over a whole
corpus fits on no machine, so equal windows are first brought together:

1. The smallest 32-gram hash inside a window depends on the window's bytes alone.  Consecutive windows
   with the same smallest hash form a *segment*, about 600 bytes for 400-byte windows; equal windows
   lie in segments of the same smallest hash, their *bucket*.  Only hashes and offsets are shuffled.
2. Buckets whose hash occurs once hold no repeat and are dropped.  Equal segments are one text with
   several places: at all but the first, every window's previous factor is whole.  One copy of each distinct
   segment is fetched, in the order of the documents, and a suffix array over whole buckets (a few MB at a
   time) is built by prefix doubling.  Positions in suffix order have a nearest smaller position above and
   below, and the longer of the two common prefixes is the longest previous factor; the nearest larger
   positions give the longest next factor in the same way.  A window repeats an earlier one if its previous
   factor is whole, and occurs elsewhere if one of the two is.
3. The distinct segments of a bucket beyond the memory bound of one suffix array are split by hashes of
   another seed, as documents are, up to ``LEVELS`` times: windows that share one smallest hash by chance
   part, equal ones never do.  What is then still beyond the bound is settled by counting window
   digests, which Spark combines before the shuffle, so no hot bucket has to fit anywhere.
4. The removed ranges go back to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint, documents

LENGTH = 400
#: Bytes of one bucket's distinct segments, and of one suffix array.
ARRAY_BYTES = 4_000_000
#: Times that a bucket beyond that is split by hashes of another seed.
LEVELS = 3
#: Windows of a segment at most; longer runs are cut.
RUN = 512
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_SEGMENT = "doc_id {id}, k1 long, base int, start int, n int, times int, bucket long, s1 long, s2 long"


def _gram(length: int) -> int:
    """Bytes of a gram: a power of two, 32 at most and a quarter of a window at most."""
    return 1 << min(5, max(0, length.bit_length() - 3))


def gram_hashes(data: np.ndarray, gram: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place on."""
    h = (data.astype(np.uint64) + np.uint64(1 + 1024 * seed)) * _C1
    step = 1
    while step < gram:
        h = h[:-step] * _C2 + h[step:]
        h ^= h >> np.uint64(29)
        h *= _C1
        h ^= h >> np.uint64(32)
        step *= 2
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, span = h, 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if span < width else m


def segments(data: np.ndarray, ends: np.ndarray, length: int, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(start, n windows, bucket, times the bucket's gram occurs) of each segment of joined texts.

    ``ends`` has for each place where its text ends; no window crosses that.
    """
    gram = _gram(length)
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 4
    h = gram_hashes(data, gram, seed)
    m = sliding_min(h, length - gram + 1)
    at = np.arange(len(m))
    valid = at + length <= ends[: len(m)]
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (m[1:] == m[:-1]) & (ends[1 : len(m)] == ends[: len(m) - 1]))
    starts = np.flatnonzero(first)
    breaks = np.flatnonzero(first | ~valid)
    breaks = np.append(breaks, len(m))
    n = breaks[np.searchsorted(breaks, starts, side="right")] - starts
    pieces = -(-n // RUN)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, n = np.repeat(starts, pieces) + nth * RUN, np.repeat(n, pieces) - nth * RUN
        n = np.minimum(n, RUN)
    low = m[starts]
    width = length - gram
    times = np.fromiter((np.count_nonzero(h[s : s + k + width] == v) for s, k, v in zip(starts, n, low)), np.int64, len(starts))
    return starts, n, low, times


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes of a string column without nulls, and its offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), offsets.astype(np.int64)


def _pieces(offsets: np.ndarray, length: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(from row, to row, from byte, to byte): whole rows up to ``size`` bytes, or parts of one row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        if j == i + 1 and hi - lo > size:
            step = max(size, length)
            for a in range(lo, max(lo + 1, hi - length + 1), step):
                yield i, j, a, min(hi, a + step + length - 1)
        else:
            yield i, j, lo, hi
        i = j


def _find(length: int, seed: int):
    """The segments of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch["text"])
            for i, j, lo, hi in _pieces(offsets, length, PIECE):
                part = data[lo:hi]
                bounds = np.minimum(offsets[i + 1 : j + 1], hi) - lo
                rows = np.repeat(np.arange(i, j), np.diff(np.concatenate([[0], bounds])))
                starts, n, low, times = segments(part, np.repeat(bounds, np.diff(np.concatenate([[0], bounds]))), length, seed)
                if not len(starts):
                    continue
                whole = memoryview(part)
                digests = np.frombuffer(
                    b"".join(xxhash.xxh3_128_digest(whole[s : s + k]) for s, k in zip(starts.tolist(), (n + length - 1).tolist())), "<i8"
                ).reshape(-1, 2)
                row = rows[starts]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(take),
                        batch["k1"].take(take),
                        batch["base"].take(take),
                        pa.array((starts + lo - offsets[row]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(times.astype(np.int32)),
                        pa.array(low.view(np.int64)),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                    ],
                    names=["doc_id", "k1", "base", "start", "n", "times", "bucket", "s1", "s2"],
                )

    return find


def _cut(length: int):
    """Bytes of the segments listed for each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch["text"])
            whole = memoryview(data)
            lists = batch["wanted"]
            counts = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(counts)), counts)
            flat = lists.flatten()
            column = {k: flat.field(k) for k in ("bucket", "s1", "s2", "start", "n")}
            lo = offsets[rows] + column["start"].to_numpy()
            hi = lo + column["n"].to_numpy() + length - 1
            upto = np.cumsum(hi - lo)
            i = 0
            while i < len(rows):  # a few MB at a time
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 4 * PIECE, side="right")))
                take = pa.array(rows[i:j])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column[k].slice(i, j - i) for k in ("bucket", "s1", "s2")),
                        batch["doc_id"].take(take),
                        batch["k1"].take(take),
                        pc.add(batch["base"].take(take), column["start"].slice(i, j - i)),
                        pa.array([whole[x:y].tobytes() for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist())], pa.binary()),
                    ],
                    names=["bucket", "s1", "s2", "doc_id", "k1", "base", "text"],
                )
                i = j

    return cut


def suffix_order(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``places`` sorted by the ``length`` bytes from there on (then by place), and common prefixes.

    The second array has for each entry the common prefix with the entry before, ``length`` at most.
    Ranks of 8, 16, 32, ... bytes come from prefix doubling.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for b in range(min(8, length)):
        key |= padded[b : n + b].astype(np.uint64) << np.uint64(56 - 8 * b)
    levels: list[tuple[int, np.ndarray]] = []
    span = min(8, length)

    def ranks(key: np.ndarray, near: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks of the keys, and the places in their order; ``near`` is an order that is almost right."""
        if near is None:
            order = np.argsort(key)
        else:  # runs that are in order already cost a merge sort no more than a look
            order = near[np.argsort(key[near], kind="stable")]
        sorted_key = key[order]
        new = np.zeros(len(key), np.int32)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        out = np.empty(len(key), np.int32)
        out[order] = np.cumsum(new, dtype=np.int32)
        return out, order

    rank, order = ranks(key, None)
    levels.append((span, rank))
    while span < length:
        step = min(span, length - span)
        later = np.zeros(n, np.uint64)
        later[: n - step] = rank[step:].astype(np.uint64) + np.uint64(1)
        key = (rank.astype(np.uint64) << np.uint64(32)) | later
        rank, order = ranks(key, order if span >= 16 else None)
        span += step
        levels.append((span, rank))
    wanted = np.zeros(n, bool)
    wanted[places] = True
    sa = order[wanted[order]]
    final = rank[sa]
    settled = np.argsort((final.astype(np.uint64) << np.uint64(32)) | sa.astype(np.uint64), kind="stable")
    sa, final = sa[settled], final[settled]
    common = np.zeros(len(sa), np.int32)
    same = np.zeros(len(sa), bool)
    same[1:] = final[1:] == final[:-1]
    common[same] = length
    i = np.flatnonzero(~same)[1:]
    a, b = sa[i - 1], sa[i]
    got = np.zeros(len(i), np.int64)
    for size, level in reversed(levels[:-1]):
        inside = (a + got < n) & (b + got < n)
        equal = inside & (level[np.minimum(a + got, n - 1)] == level[np.minimum(b + got, n - 1)])
        got[equal] += size
    for _ in range(7):
        inside = (a + got < n) & (b + got < n)
        equal = inside & (padded[np.minimum(a + got, n - 1)] == padded[np.minimum(b + got, n - 1)])
        live = equal if _ == 0 else live & equal
        got[live] += 1
    common[i] = np.minimum(got, length - 1)
    return sa, common


def _nearest(sa: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Common prefix of each entry with the nearest entry above it whose position is smaller, 0 if none.

    Each entry walks up by way of what others have passed already, so that steps double.
    """
    n = len(sa)
    up = np.arange(-1, n - 1)
    low = common.copy()
    low[0] = 0
    active = np.flatnonzero((up >= 0) & (sa[np.maximum(up, 0)] > sa))
    while len(active):
        at = up[active]
        low[active] = np.minimum(low[active], low[at])
        up[active] = up[at]
        at = up[active]
        active = active[(at >= 0) & (sa[np.maximum(at, 0)] > sa[active])]
    low[up < 0] = 0
    return low


def longest_factors(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor from each of ``places`` (ascending), capped at ``length``.

    The previous factor is the longer of the common prefixes with the nearest smaller positions above and
    below in suffix order, the next factor the same with the nearest larger ones.
    """
    sa, common = suffix_order(data, places, length)
    upwards = np.append(common[1:], 0)[::-1].astype(np.int32)  # the same order read from its end
    previous = np.maximum(_nearest(sa, common), _nearest(sa[::-1], upwards)[::-1])
    following = np.maximum(_nearest(-sa, common), _nearest(-sa[::-1], upwards)[::-1])
    back = np.empty(len(sa), np.int64)
    back[np.searchsorted(places, sa)] = np.arange(len(sa))
    return previous[back], following[back]


def _runs(hit: np.ndarray, length: int) -> list[int]:
    """Byte ranges [a, b, a, b, ...] that windows starting where ``hit`` holds cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if out and a <= out[-1]:
            out[-1] = b + length - 1
        else:
            out += [a, b + length - 1]
    return out


def _factor(length: int, array_bytes: int):
    """Suffix arrays over whole buckets, which arrive together and each in the documents' order."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        base = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        places = np.repeat(base, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        previous, following = longest_factors(data, places, length)
        later, anywhere = previous >= length, np.maximum(previous, following) >= length
        out, at = [], 0
        for r, k in zip(rows, counts.tolist()):
            if anywhere[at : at + k].any():
                out.append((*r[:3], _runs(anywhere[at : at + k], length), _runs(later[at : at + k], length)))
            at += k
        columns = list(zip(*out)) or [()] * 5
        ints = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [ints] * 2)], names=["bucket", "s1", "s2", "anywhere", "later"])

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for r in zip(*(batch[k].to_pylist() for k in ("bucket", "s1", "s2", "text"))):
                if rows and r[:3] == rows[-1][:3]:
                    continue  # rows with equal id and text bring their segment once each
                if held >= array_bytes // 2 and r[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[3])
        if rows:
            yield settle(rows)

    return factor


def _windows(length: int):
    """Digest of each window of segments in buckets that are too large for one suffix array."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, body in enumerate(batch["text"].to_pylist()):
                n = len(body) - length + 1
                whole = memoryview(body)
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[i : i + length]) for i in range(n)), "<i8").reshape(-1, 2)
                take = pa.array(np.full(n, row))
                yield pa.RecordBatch.from_arrays(
                    [*(batch[k].take(take) for k in ("bucket", "s1", "s2", "doc_id", "k1", "base")), pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1])],
                    names=["bucket", "s1", "s2", "doc_id", "k1", "base", "i", "w1", "w2"],
                )

    return digest


def _united(found: list[dict], kind: str) -> list[list[int]]:
    """Maximal removed ranges of one text."""
    merged: list[list[int]] = []
    for a, b in sorted((f["start"] + p, f["start"] + q) for f in found for p, q in zip(f[kind][::2], f[kind][1::2])):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return merged


def _remove(kind: str, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _texts(batch["text"])
            whole = memoryview(data)
            out: list[list] = [[], [], [], [], [], [], []]
            for i, found in enumerate(batch["ranges"].to_pylist()):
                lo, n = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                later = _united(found or [], "later")
                gone = later if kind == "later" else _united(found or [], kind)
                edges = [0, *(x for m in gone for x in m), n]
                kept = b"".join(whole[lo + a : lo + b] for a, b in zip(edges[::2], edges[1::2]))
                row = (n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in later), len(later), kept if with_text else None)
                for c, v in zip(out, row):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, out, kinds)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_removed_later", "n_spans_later", "kept"],
            )

    return remove


def _repeats(units: DataFrame, length: int, array_bytes: int, level: int = 0) -> DataFrame:
    """``doc_id, k1, base, ranges``: repeated ranges of ``units (doc_id, k1, base, text)``.

    A unit is the part of a document from byte ``base`` on; rows with equal ``(doc_id, k1, base)`` are equal.
    A range has ``start`` in the unit and, from there, bounds of strings that occur ``anywhere`` else, and of
    those with an earlier place (``later``).
    """
    kind = units.schema["doc_id"].dataType.simpleString()
    key, unit = ["bucket", "s1", "s2"], ["doc_id", "k1", "base"]
    found = checkpoint(units.where(F.octet_length("text") >= length).mapInArrow(_find(length, level), _SEGMENT.format(id=kind)))
    # Totals are written before they are joined, so that adaptive execution can split a hot bucket's rows.
    several = checkpoint(found.groupBy("bucket").agg(F.sum("times").alias("total")).where("total > 1").select("bucket"))
    found = checkpoint(found.join(several, "bucket"))  # most segments end here
    distinct = found.groupBy(*key).agg(F.count("*").alias("copies"), F.max("times").alias("times"), F.min(F.struct(*unit, "start", "n")).alias("place"))
    totals = checkpoint(distinct.groupBy("bucket").agg(F.count("*").alias("kinds"), F.sum(F.col("place.n") + (length - 1)).alias("bytes")))
    repeated = checkpoint(distinct.join(totals, "bucket"))
    mixed = repeated.where("NOT (kinds = 1 AND times = 1)")  # others are copies without a repeat inside

    def same(a: str, b: str, *columns: str):
        on = F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
        for c in columns:
            on = on & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
        return on

    def fetch(some: DataFrame) -> DataFrame:
        """The bytes of distinct segments, as units of their first place."""
        wanted = some.select("place.doc_id", "place.k1", "place.base", F.struct(*key, "place.start", "place.n").alias("w"))
        wanted = wanted.groupBy(*unit).agg(F.collect_set("w").alias("wanted"))
        rows = units.alias("a").join(wanted.alias("b"), same("a", "b", "k1", "base")).select("a.doc_id", "a.k1", "a.base", "a.text", "b.wanted")
        return rows.mapInArrow(_cut(length), f"bucket long, s1 long, s2 long, doc_id {kind}, k1 long, base int, text binary")

    settled = (
        fetch(mixed.where(F.col("bytes") <= array_bytes))
        .repartition("bucket")
        .sortWithinPartitions("bucket", *unit, "s1", "s2")
        .mapInArrow(_factor(length, array_bytes), "bucket long, s1 long, s2 long, anywhere array<int>, later array<int>")
    )
    hot = mixed.where(F.col("bytes") > array_bytes)
    if not hot.isEmpty():
        if level < LEVELS:
            parts = _repeats(fetch(hot).select(*unit, "text"), length, array_bytes, level + 1)
            owners = hot.select(*key, "place.doc_id", "place.k1", (F.col("place.base") + F.col("place.start")).alias("base"))
            moved = lambda k: F.flatten(F.transform("b.ranges", lambda r: F.transform(r[k], lambda x: x + r["start"]))).alias(k)
            rest = owners.alias("a").join(parts.alias("b"), same("a", "b", "k1", "base")).select(*(f"a.{k}" for k in key), moved("anywhere"), moved("later"))
        else:
            windows = fetch(hot).mapInArrow(_windows(length), f"bucket long, s1 long, s2 long, doc_id {kind}, k1 long, base int, i int, w1 long, w2 long")
            order = F.struct("doc_id", "k1", (F.col("base") + F.col("i")).alias("at"))
            twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("copies"), F.min(order).alias("lowest")).where("copies > 1")
            here = F.array(F.col("i"), F.col("i") + length)
            later = F.flatten(F.collect_set(F.when(~order.eqNullSafe(F.col("lowest")), here))).alias("later")
            rest = windows.join(twice, ["w1", "w2"]).groupBy(*key).agg(F.flatten(F.collect_set(here)).alias("anywhere"), later)
        settled = settled.unionByName(rest)
    copied = repeated.where("copies > 1")
    known = copied.select(*key, "place", F.expr(f"array(0, place.n + {length - 1})").alias("cut")).join(settled, key, "full")
    known = checkpoint(known)  # again for the sake of hot segments
    none = F.expr("cast(array() AS array<int>)")
    first = same("place", "f", "k1", "base", "start")
    cuts = found.alias("f").join(known, key).select(
        "f.doc_id", "f.k1", "f.base", "f.start",
        F.coalesce("cut", "anywhere").alias("anywhere"),
        F.when(F.col("cut").isNotNull() & ~first, F.col("cut")).otherwise(F.coalesce("later", none)).alias("later"),
    )
    return cuts.groupBy(*unit).agg(F.collect_set(F.struct("start", "anywhere", "later")).alias("ranges"))


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    keep: str = "first",
    doc_id: str = "doc_id",
    text: str = "text",
    array_bytes: int = ARRAY_BYTES,
    with_text: bool = True,
) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_removed_later, n_spans_later, kept (bytes).

    ``keep="none"`` removes every copy of a repeated string, ``"first"`` all but the one that comes
    first by ``(doc_id, row hash, offset)``; ``n_removed_later`` and ``n_spans_later`` say what ``"first"`` removes
    in either case.  A null text is empty; null ids sort first; texts shorter
    than ``length`` stay whole; rows with equal id and text share a place in that order, so ``"first"``
    keeps the string in each of them; empty tables give empty tables; other columns are ignored,
    whatever their names.  ``kept`` is binary because a cut may fall inside a character.
    """
    if keep not in ("first", "none") or length < 2:
        raise ValueError("keep is 'first' or 'none', and length is 2 or more")
    slim = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k1"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    bounded_batches(docs.sparkSession)
    kind = slim.schema["doc_id"].dataType.simpleString()
    ranges = _repeats(slim.select("doc_id", "k1", F.lit(0).alias("base"), "text"), length, array_bytes)
    out = (
        slim.alias("a")
        .join(ranges.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.k1") == F.col("b.k1")), "left")
        .select("a.doc_id", "a.text", "b.ranges")
        .mapInArrow(
            _remove("later" if keep == "first" else "anywhere", with_text),
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_removed_later long, n_spans_later long, kept binary",
        )
    )
    return out if with_text else out.drop("kept")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir), LENGTH, keep="none", with_text=False)
    return found.withColumn("repeated", F.col("n_removed") > 0)


#: Digests of all windows of all texts; for small tables.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, encode(coalesce(text, '')) AS body FROM documents
), w AS (
  SELECT uid, doc_id, i, md5(body[i:i + 399]) AS h
  FROM (SELECT uid, doc_id, body, unnest(range(1, octet_length(body) - 398)) AS i FROM d WHERE octet_length(body) >= 400)
), twice AS (
  SELECT h, min(struct_pack(doc_id := doc_id, i := i)) AS lowest FROM w GROUP BY h HAVING count(*) > 1
), hits AS (
  SELECT uid, i, kind FROM w JOIN twice USING (h), (VALUES ('any'), ('later')) k(kind)
  WHERE kind = 'any' OR struct_pack(doc_id := doc_id, i := i) <> lowest
), hit AS (
  SELECT uid, kind, i, i - lag(i) OVER (PARTITION BY uid, kind ORDER BY i) > 400 AS apart FROM hits
), spans AS (
  SELECT uid, kind, min(i) AS a, max(i) + 400 AS b
  FROM (SELECT uid, kind, i, count(*) FILTER (apart) OVER (PARTITION BY uid, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS nth FROM hit) GROUP BY uid, kind, nth
), span AS (
  SELECT uid, a, b FROM spans WHERE kind = 'any'
), later AS (
  SELECT uid, sum(b - a)::BIGINT AS n, count(*) AS spans FROM spans WHERE kind = 'later' GROUP BY uid
), gap AS (
  SELECT uid, a, coalesce(lag(b) OVER (PARTITION BY uid ORDER BY a), 1) AS since FROM span
  UNION ALL SELECT d.uid, octet_length(body) + 1, coalesce((SELECT max(b) FROM span s WHERE s.uid = d.uid), 1) FROM d
), kept AS (
  SELECT uid, string_agg(hex(body[since:a - 1]), '' ORDER BY since) AS k FROM gap JOIN d USING (uid) WHERE a > since GROUP BY uid
), counted AS (
  SELECT doc_id, uid, octet_length(body)::BIGINT AS n_bytes, (octet_length(body) - coalesce(length(k), 0) // 2)::BIGINT AS n_removed,
         (SELECT count(*) FROM span s WHERE s.uid = d.uid) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
  FROM d LEFT JOIN kept USING (uid)
)
SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256, coalesce(n, 0) AS n_removed_later, coalesce(spans, 0) AS n_spans_later, n_removed > 0 AS repeated
FROM counted LEFT JOIN later USING (uid)
"""
