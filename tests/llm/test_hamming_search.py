"""Exact search against brute force, with segments of both widths and small groups."""

import numpy as np
import pytest
from conftest import SMALL

from parcelar.llm import hamming_search as m


def brute(codes, queries, k):
    out = []
    for q in queries:
        distance = np.bitwise_count(codes ^ codes[q]).astype(int)
        order = np.lexsort((np.arange(len(codes)), distance))[:k]
        out += [(q, r + 1, int(i), int(distance[i])) for r, i in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("width, group, spread", [(16, 20_000, 64), (16, 30, 64), (32, 20_000, 64), (32, 40, 6), (8, 25, 64)])
def test_against_brute_force(spark, width, group, spread):
    """Codes near a few centres and far apart: queries need from one to many rounds."""
    rng = np.random.default_rng(width + group)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, min(spread, 12)), replace=False)) for _ in range(600)], np.uint64)
    codes = np.where(rng.random(600) < 0.7, centres[rng.integers(0, 5, 600)] ^ flips, rng.integers(0, 2**63, 600, dtype=np.uint64))
    codes[::50] = codes[0]
    mask = np.uint64(2**width - 1)
    rows = [(i, [int((c >> np.uint64(lo)) & mask) for lo in range(0, 64, width)]) for i, c in enumerate(codes)]
    entries = spark.createDataFrame(rows, "id long, code array<long>").repartition(3)
    got = m.hamming_top_k(entries, entries.where("id % 60 = 0"), 64, width, 7, group)
    assert sorted((r["query_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in got.collect()) == brute(codes, range(0, 600, 60), 7)


def test_wide_segments_give_the_same_neighbours(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    narrow, wide = (m.top_k_vectors(vectors, vectors.where("vec_id % 100 = 0"), 64, wide=w) for w in (1 << 22, 0))
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect()))
