"""Decoders, objective and classic heuristics on small random graphs."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelar.operators import classic, kernels
from parcelar.operators.classic import CLASSIC
from parcelar.operators.kernels import Graph, contiguous, decode_greedy, decode_mst, decode_shortest, objective
from parcelar.plans.search import SearchConfig, run_kernel


def path(x=(0.0, 1.0, 10.0, 11.0)):
    n = len(x)
    return Graph(np.array(x)[:, None], np.arange(n - 1), np.arange(1, n))


@st.composite
def graphs(draw, connected=True):
    n = draw(st.integers(2, 9))
    x = draw(st.lists(st.integers(0, 3), min_size=n, max_size=n))  # many equal features, so many ties
    extra = draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=8))
    edges = {(min(a, b), max(a, b)) for a, b in extra if a != b}
    if connected:
        edges |= {(draw(st.integers(0, i - 1)), i) for i in range(1, n)}
    edges = sorted(edges)
    return Graph(np.array(x, float)[:, None], np.array([a for a, _ in edges], int), np.array([b for _, b in edges], int))


def genes(method, g, seed):
    return np.random.default_rng(seed).random(kernels.chromosome_length(method, g.n, g.m))


def pairwise(g, region):
    total = 0.0
    for r in set(region.tolist()) - {0}:
        part = np.flatnonzero(region == r).tolist()
        total += sum(g.distance[i, j] for i, j in itertools.combinations(part, 2)) / len(part)
    return total


@settings(max_examples=60, deadline=None)
@given(graphs(), st.integers(0, 99), st.data())
def test_decoders_on_connected_graphs(g, seed, data):
    k = data.draw(st.integers(1, g.n))
    for method, decode in kernels.DECODERS.items():
        region = decode(g, k, genes(method, g, seed))
        if method == "shortest":  # zero weights can empty a region
            assert set(region.tolist()) <= set(range(1, k + 1))
        else:
            assert set(region.tolist()) == set(range(1, k + 1)), method
        assert contiguous(g, region), method
        assert abs(objective(g, region) - pairwise(g, region)) < 1e-9


@settings(max_examples=40, deadline=None)
@given(graphs(connected=False), st.integers(0, 99), st.data())
def test_decoders_on_any_graph(g, seed, data):
    k = data.draw(st.integers(1, g.n))
    whole = kernels.components(g, list(range(g.m)))
    parts = int(whole.max())
    tree = len(kernels.spanning_edges(g, g.d))
    mst = decode_mst(g, k, genes("mst", g, seed))
    assert mst.max() == parts + min(k - 1, tree)
    shortest = decode_shortest(g, k, genes("shortest", g, seed))
    assert set(shortest.tolist()) <= set(range(1, k + 1))
    keys = genes("greedy", g, seed)
    region = decode_greedy(g, k, keys)
    reached = {int(whole[s]) for s in kernels.seeds(keys[g.n * (g.n - 1) // 2 :], k)}
    assert all((region[v] > 0) == (int(whole[v]) in reached) for v in range(g.n))


@settings(max_examples=30, deadline=None)
@given(graphs(), st.integers(0, 99), st.data())
def test_greedy_takes_the_cheapest_element(g, seed, data):
    """Each step's value is the gain of the perturbed objective, and the least that is feasible."""
    k = data.draw(st.integers(1, g.n))
    keys = genes("greedy", g, seed)
    near = keys[: g.n * (g.n - 1) // 2][g.pair_place()] * g.distance if g.n > 1 else np.zeros((1, 1))
    near = np.array(near)
    np.fill_diagonal(near, 0)

    def cost(nodes):
        return sum(near[i, j] for i, j in itertools.combinations(nodes, 2)) / len(nodes)

    trace = []
    decode_greedy(g, k, keys, trace)
    regions = {r: [int(s)] for r, s in enumerate(kernels.seeds(keys[g.n * (g.n - 1) // 2 :], k), 1)}
    for r, v, value, total in trace:
        taken = {i for nodes in regions.values() for i in nodes}
        assert abs(total - sum(map(cost, regions.values()))) < 1e-9
        options = {}
        for q, nodes in regions.items():
            for u in nodes:
                for b, _ in g.neighbours[u]:
                    if b not in taken:
                        options[q, b] = cost([*nodes, b]) - cost(nodes)
        assert abs(value - options[r, v]) < 1e-9
        assert value <= min(options.values()) + 1e-9
        regions[r].append(v)


@settings(max_examples=25, deadline=None)
@given(graphs(), st.data(), st.integers(0, 5))
def test_classic_heuristics(g, data, seed):
    k = data.draw(st.integers(1, g.n))
    for name, f in CLASSIC.items():
        region = f(g, k, seed)
        assert set(region.tolist()) == set(range(1, k + 1)), name
        assert contiguous(g, region), name


def test_classic_heuristics_on_two_components():
    g = Graph(np.array([0.0, 1, 5, 6, 9])[:, None], np.array([0, 2, 3]), np.array([1, 3, 4]))
    for name, f in CLASSIC.items():
        for seed in range(5):
            region = f(g, 3, seed)
            assert set(region.tolist()) == {1, 2, 3} and contiguous(g, region), name


def test_path_is_solved():
    g = path()
    for name in ("skater", "redcap", "schc", "azp_greedy", "azp_tabu"):
        assert objective(g, CLASSIC[name](g, 2, 1)) == pytest.approx(1.0), name
    found = run_kernel(g, 2, SearchConfig(population_size=10, max_generations=10, max_time=None), "mst")
    assert found["f"] == pytest.approx(1.0)


def test_one_region_and_all_regions():
    g = path()
    assert objective(g, decode_mst(g, 1, genes("mst", g, 0))) == pytest.approx(((g.x - g.x.mean()) ** 2).sum())
    assert objective(g, decode_mst(g, 4, genes("mst", g, 0))) == 0


def test_equal_weights_go_by_edge_number():
    g = Graph(np.zeros((3, 1)), np.array([0, 0, 1]), np.array([1, 2, 2]))
    assert kernels.spanning_edges(g, g.d) == [0, 1]


@pytest.mark.parametrize("linkage", classic.LINKAGES)
def test_linkages_give_connected_regions(linkage):
    rng = np.random.default_rng(3)
    cells = np.arange(30).reshape(5, 6)
    u = np.concatenate([cells[:, :-1].ravel(), cells[:-1].ravel()])
    v = np.concatenate([cells[:, 1:].ravel(), cells[1:].ravel()])
    graph = Graph(rng.normal(size=(30, 3)), u, v)
    for found in (classic.schc(graph, 5, linkage_method=linkage), classic.redcap(graph, 5, method=f"fullorder-{linkage}linkage")):
        assert len(set(found.tolist())) == 5 and contiguous(graph, found)
    assert (classic.redcap(graph, 5, method="firstorder-singlelinkage") == classic.skater(graph, 5)).all()
    with pytest.raises(ValueError):
        classic.redcap(graph, 5, method="none")
    with pytest.raises(ValueError):
        classic.schc(graph, 5, linkage_method="none")
