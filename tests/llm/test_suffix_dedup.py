"""Substring removal against a brute-force version, and the arrays against their definition."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from parcelar.llm import suffix_dedup as m


def brute(rows, length, keep):
    places = defaultdict(list)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            places[b[i : i + length]].append((d, i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone, later = bytearray(len(b)), bytearray(len(b))
        for i in range(len(b) - length + 1):
            found = places[b[i : i + length]]
            if len(found) > 1:
                gone[i : i + length] = b"\x01" * length
            if min(found) != (d, i):
                later[i : i + length] = b"\x01" * length
        if keep == "first":
            gone = later
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = lambda g: sum(1 for i in range(len(b)) if g[i] and not (i and g[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans(gone), hashlib.sha256(kept).hexdigest(), sum(later), spans(later)))
    return sorted(out)


def texts():
    random.seed(1)
    some = lambda n: "".join(random.choice("abc d") for _ in range(n))
    common = [some(random.randint(5, 80)) for _ in range(12)]
    rows = [(i, "".join(random.choice([some(random.randint(1, 40)), random.choice(common)]) for _ in range(random.randint(0, 8)))) for i in range(100)]
    return [*rows, (200, None), (201, ""), (202, "a" * 3000), (203, "ab" * 700), (204, "é" * 300), (205, rows[3][1]), (206, rows[3][1])]


@pytest.mark.parametrize("length, keep, array_bytes, piece", [(10, "none", 4_000_000, 1 << 20), (16, "first", 4_000_000, 500), (16, "none", 1500, 500), (40, "first", 1500, 1 << 20)])
def test_against_brute_force(spark, monkeypatch, length, keep, array_bytes, piece):
    monkeypatch.setattr(m, "PIECE", piece)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.remove_repeats(docs, length, keep, array_bytes=array_bytes, with_text=False)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, length, keep)


@pytest.mark.parametrize("array_bytes", [4_000_000, 60])
def test_repeated_rows_keep_the_first(spark, array_bytes):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abc d") for _ in range(n))
    common = [some(rng.randint(12, 50)) for _ in range(6)]
    rows = [(i, "".join(rng.choice([some(rng.randint(1, 20)), rng.choice(common)]) for _ in range(rng.randint(2, 7)))) for i in range(40)]
    rows += rows[::3] + rows[::6] + [(90, "ab" * 60), (90, "ab" * 60), (91, "qrstuvwxyz0123456789" * 4), (91, "qrstuvwxyz0123456789" * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = m.remove_repeats(docs, 16, "first", array_bytes=array_bytes, with_text=False)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 16, "first")


@pytest.mark.parametrize("levels", [0, 3])
def test_a_hot_bucket_is_split(spark, monkeypatch, levels):
    """Many texts around one phrase, which lends them its hash: split by other seeds, or counted at last."""
    monkeypatch.setattr(m, "LEVELS", levels)
    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    phrase, copies = some(24), [some(40) for _ in range(4)]
    rows = [(i, some(rng.randint(0, 30)) + phrase + rng.choice(copies)[: rng.randint(5, 40)] + some(rng.randint(0, 20))) for i in range(60)]
    rows += rows[:5] + [(100 + i, t) for i, t in rows[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keep in ("none", "first"):
        got = m.remove_repeats(docs, 32, keep, array_bytes=400, with_text=False)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, 32, keep)


def test_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "abcdefghij tail"), (2, "head abcdefghij")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in m.remove_repeats(docs, 8).collect()} == {1: b"abcdefghij tail", 2: b"head "}


@pytest.mark.parametrize("seed", range(4))
def test_longest_factors(seed):
    random.seed(seed)
    data = np.frombuffer(bytes(random.choice(b"ab") for _ in range(300)), np.uint8)
    length = 24
    places = np.arange(0, 300 - length + 1)
    previous, following = m.longest_factors(data, places, length)
    raw = data.tobytes()

    def common(i, j):
        n = 0
        while n < length and raw[i + n] == raw[j + n]:
            n += 1
        return n

    for i in places.tolist():
        assert previous[i] == max((common(i, j) for j in range(i)), default=0)
        assert following[i] == max((common(i, j) for j in places.tolist() if j > i), default=0)


def test_planted_passages_of_57_words(spark, tmp_path):
    """The contract counts bytes: passages that other documents repeat go from 400 bytes on, however many words they have."""
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        head, tail = (" ".join(some(6) for _ in range(rng.randint(0, 300))) for _ in range(2))
        if i % 3 == 0:  # for this document and the next, not for the third
            passage = " ".join([some(6) for _ in range(56)] + [some(7 + i // 3 % 2)])
        text = head + "<>."[i % 3] + (passage if i % 3 < 2 else "") + "<>."[i % 3] + tail
        rows.append((i, text))
        want[i] = (len(text), 400 if i % 3 < 2 and len(passage) == 400 else 0)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in m.op1_suffix_dedup(spark, str(tmp_path)).collect()} == want
