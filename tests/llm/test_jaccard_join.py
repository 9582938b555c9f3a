import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from parcelar.llm import jaccard_join as m
from parcelar.llm.components import connected_components


def brute(rows, threshold=0.8, n=5):
    texts = defaultdict(list)
    for d, t in rows:
        texts[t or ""].append(d)
    names, sets = list(texts), []
    for t in names:
        w = re.findall(r"\w+", t.lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent, links = list(range(len(names))), [0] * len(names)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(names)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold - 1e-12:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    classes = defaultdict(list)
    for i, t in enumerate(names):
        classes[find(i)] += [d for d in texts[t] if d is not None]
    out = [(d, min(classes[find(i)], default=None), links[i], len(texts[t])) for i, t in enumerate(names) for d in texts[t]]
    return sorted(out, key=str)


def rows():
    random.seed(1)
    words = [f"w{i}" for i in range(50)]
    base = [[random.choice(words) for _ in range(random.randint(1, 120))] for _ in range(20)]
    out = []
    for i in range(250):
        b = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            b[random.randrange(len(b))] = random.choice(words)
        out.append((i, " ".join(b)))
    return [*out, (500, None), (501, ""), (502, "..."), (None, out[0][1]), (3, out[3][1]), (None, "x y z")]


@pytest.mark.parametrize("block, share", [(400, 0.5), (15, 0.5), (15, 1e9)])  # the last compares per bucket
def test_against_brute_force(spark, block, share):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in m.jaccard_links(docs, block_texts=block, bucket_share=share).collect()), key=str)
    assert got == brute(rows())


def test_differences_have_the_same_intersections():
    rng = random.Random(3)
    first = np.unique(np.array([rng.randrange(400) for _ in range(150)], np.uint64))
    texts = [first, *(np.unique(np.concatenate([rng.sample(first.tolist(), rng.randint(0, len(first))), [rng.randrange(400) for _ in range(rng.randint(1, 60))]])).astype(np.uint64) for _ in range(30))]
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in texts]), pa.array([first.tobytes()] * len(texts))], names=["grams", "first"])
    rows = next(m._differ(iter([batch]))).to_pylist()
    assert len({r["less"] is None for r in rows}) == 2  # some written out, some not
    sets = [m.Grams(r["size"], r["base"], r["common"], None if r["less"] is None else np.frombuffer(r["less"], np.uint64), np.frombuffer(r["more"], np.uint64)) for r in rows]
    pairs = np.array([(a, b) for a in range(len(texts)) for b in range(a)])
    want = [len(set(texts[a].tolist()) & set(texts[b].tolist())) / len(set(texts[a].tolist()) | set(texts[b].tolist())) for a, b in pairs.tolist()]
    sizes = np.array([len(x) for x in texts])
    assert np.allclose(m._jaccard(sets, sizes, pairs), want)
    for k in range(0, len(pairs), 3):  # few pairs take another way
        assert np.allclose(m._jaccard(sets, sizes, pairs[k : k + 3]), want[k : k + 3])


def test_both_ways_compare_the_same_pairs(spark):
    """With few bands pairs are missed; by component and by bucket the same ones are."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    options = {"n_bands": 4, "n_rows": 8, "block_texts": 10}
    whole, per_bucket = (sorted(map(str, m.jaccard_links(docs, bucket_share=share, **options).collect())) for share in (0, 1e9))
    assert whole == per_bucket != sorted(str(r) for r in m.jaccard_links(docs).collect())


def test_representatives_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, 6, 7), (2, "a b c d e f g", 8, 9, 1), (3, "other words", 2, 3, 4)], "doc_id long, text string, _k long, k long, row long")
    got = sorted(map(tuple, m.keep_representatives(docs).collect()))
    assert got == [(1, "a b c d e f g", 5, 6, 7), (3, "other words", 2, 3, 4)]


def test_pruning_keeps_what_can_reach_the_threshold():
    looks = m.least_matches(160, 32, 0.8, 1e-6)
    assert [n for n, _ in looks] == [32, 64, 96, 128, 160]
    assert all(0 < least < 0.8 * n for n, least in looks)
    assert all(a[1] / a[0] <= b[1] / b[0] for a, b in zip(looks, looks[1:]))


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("at_once", [0, 100, 2_000_000])
def test_components_by_steps_and_at_once(spark, at_once):
    rng = random.Random(5)
    edges = [(rng.randrange(-600, 600), rng.randrange(-600, 600)) for _ in range(500)] + [(10_000 + i, 10_001 + i) for i in range(200)]
    edges += [(7, 7), (20_000, -20_000), (-20_000, 20_000)] + [(30_000 + i, 40_000) for i in range(300)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    rows = connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7), at_once).collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == {x: find(x) for x in parent if find(x) != x}


def test_components_take_few_jobs(spark):
    """Plans of many steps fill the driver's memory; a graph of this size needs one shuffle."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(3000)], "u long, v long").repartition(5)
    spark.sparkContext.setJobGroup("components", "")
    try:
        connected_components(edges).collect()
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
        for name in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(name, None)
    assert jobs <= 12
