"""Decontamination against plain Python, broadcast and shuffled, with short items and edge-case rows."""

import hashlib
import random
import re

import pytest
from conftest import SMALL
from edge import edge_documents

from parcelar.llm import decontamination as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [m.BROADCAST_WINDOWS, 0])
def test_against_plain_python(spark, bound):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice(["ab", "CD", "é9", "f"]) for _ in range(n))
    items = [(i, some(rng.randint(0, 25))) for i in range(25)] + [(30, None), (31, ""), (32, "one-word"), (None, "two words"), (3, some(12)), (3, some(12))]
    docs = [(i, some(rng.randint(0, 60)) + rng.choice(["", "; ", " two, WORDS "]) + (rng.choice(items)[1] or "") + some(3)) for i in range(80)]
    docs += [(200, None), (201, ""), (None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (5, "another one word")]
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in m.decontaminate(left, right, broadcast_windows=bound).collect()), key=str)
    assert got == brute(docs, items)


@pytest.mark.parametrize("bound", [m.BROADCAST_WINDOWS, 0])
def test_edge_rows(spark, bound):
    docs = edge_documents(spark)
    items = [(1, "repeated row of seven"), (None, None), (2, ""), (2, "word"), (7, "word " * 12)]
    got = m.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_windows=bound)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(plain, items)


def test_both_ways_on_documents(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    a, b = (sorted(map(tuple, m.decontaminate(docs, items, broadcast_windows=n).collect())) for n in (m.BROADCAST_WINDOWS, 0))
    assert a == b and any(r[-1] for r in a)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some one two three", 5, 6), (2, "clean", 7, 8)], "doc_id long, text string, _doc_id long, _k1 long")
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert [tuple(r) for r in m.drop_contaminated(docs, items).collect()] == [(2, "clean", 7, 8)]
