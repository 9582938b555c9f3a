"""Numpy kernels on one graph: decoders, objective and connectivity.

A kernel sees one instance; Spark deals instances, runs and chromosomes out.  All ties are broken by a
total order, so results depend on nothing but the input.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np


class Graph:
    """Nodes 0..n-1 with features ``x`` (n x m) and edges (u, v) in edge-id order."""

    def __init__(self, x: np.ndarray, u: np.ndarray, v: np.ndarray):
        self.x = np.asarray(x, float).reshape(len(x), -1)
        self.u, self.v = np.asarray(u, int), np.asarray(v, int)
        self.n, self.m = len(self.x), len(self.u)
        self.d = ((self.x[self.u] - self.x[self.v]) ** 2).sum(axis=1) if self.m else np.zeros(0)

    @cached_property
    def neighbours(self) -> list[list[tuple[int, int]]]:
        """(neighbour, edge id) of each node."""
        out: list[list[tuple[int, int]]] = [[] for _ in range(self.n)]
        for e, (a, b) in enumerate(zip(self.u.tolist(), self.v.tolist())):
            out[a].append((b, e))
            out[b].append((a, e))
        return out

    @cached_property
    def distance(self) -> np.ndarray:
        """All squared distances."""
        out = np.zeros((self.n, self.n))
        for column in self.x.T:  # a matrix at a time, and exact where features are equal
            out += (column[:, None] - column[None, :]) ** 2
        return out

    def pair_place(self) -> np.ndarray:
        """Row-major number of each pair in the strict upper triangle, as a symmetric matrix."""
        i, j = np.triu_indices(self.n, 1)
        place = np.zeros((self.n, self.n), np.int64)
        place[i, j] = place[j, i] = np.arange(len(i))
        return place


class Forest:
    """Disjoint sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = self.parent[self.parent[a]]
            a = self.parent[a]
        return a

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def numbered(roots: list[int]) -> np.ndarray:
    """Regions from 1 in order of their smallest node, for the smallest node of each node's region."""
    order = {r: i + 1 for i, r in enumerate(sorted(set(roots)))}
    return np.array([order[r] for r in roots])


def spanning_edges(graph: Graph, weight: np.ndarray) -> list[int]:
    """Edge ids of the minimum spanning forest, in order of (weight, edge id)."""
    forest = Forest(graph.n)
    u, v = graph.u.tolist(), graph.v.tolist()
    return [e for e in np.lexsort((np.arange(graph.m), weight)).tolist() if forest.union(u[e], v[e])]


def components(graph: Graph, edges: list[int]) -> np.ndarray:
    """Regions by connectivity through some edges."""
    forest = Forest(graph.n)
    for e in edges:
        forest.union(int(graph.u[e]), int(graph.v[e]))
    return numbered([forest.find(i) for i in range(graph.n)])


def decode_mst(graph: Graph, k: int, genes: np.ndarray) -> np.ndarray:
    """Spanning forest of perturbed weights without the k - 1 edges of the largest second keys."""
    weight, second = genes[: graph.m] * graph.d, genes[graph.m :]
    tree = spanning_edges(graph, weight)
    tree.sort(key=lambda e: (-second[e], weight[e], e))
    return components(graph, tree[k - 1 :])


def seeds(node_keys: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((np.arange(len(node_keys)), node_keys))[:k]


def decode_shortest(graph: Graph, k: int, genes: np.ndarray) -> np.ndarray:
    """Each node joins its nearest seed by perturbed path length; ties and no path at all go to the lowest region.

    Where weights are zero a seed may be as near to a lower seed, and its own region stays empty.
    """
    return nearest_seeds(graph, (genes[: graph.m] * graph.d).tolist(), seeds(genes[graph.m :], k).tolist())


def nearest_seeds(graph: Graph, weight: list[float], chosen: list[int]) -> np.ndarray:
    best = [(np.inf, 1)] * graph.n
    queue = []
    for region, s in enumerate(chosen, 1):
        best[s] = (0.0, region)
        queue.append((0.0, region, s))
    heapq.heapify(queue)
    while queue:
        length, region, a = heapq.heappop(queue)
        if (length, region) > best[a]:
            continue
        for b, e in graph.neighbours[a]:
            step = (length + weight[e], region)
            if step < best[b]:
                best[b] = step
                heapq.heappush(queue, (*step, b))
    return np.array([region for _, region in best])


def seed_lengths(graph: Graph, k: int, genes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds, and the perturbed path length from each of them to each node (k x n)."""
    weight = (genes[: graph.m] * graph.d).tolist()
    chosen = seeds(genes[graph.m :], k)
    out = np.full((k, graph.n), np.inf)
    for row, s in enumerate(chosen.tolist()):
        out[row, s] = 0.0
        queue = [(0.0, s)]
        while queue:
            length, a = heapq.heappop(queue)
            if length > out[row, a]:
                continue
            for b, e in graph.neighbours[a]:
                if length + weight[e] < out[row, b]:
                    out[row, b] = length + weight[e]
                    heapq.heappush(queue, (length + weight[e], b))
    return chosen, out


def decode_greedy(graph: Graph, k: int, genes: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Regions grow from seeds by the cheapest feasible (node, region); 0 for nodes that none reaches.

    The cost of giving v to region r is (sum of its distances to r - cost of r) / (size of r + 1), on the
    perturbed distances.  The sums are kept per region for all nodes, so a step updates one row.
    """
    n = graph.n
    pairs = n * (n - 1) // 2
    near = genes[:pairs][graph.pair_place()] * graph.distance if pairs else np.zeros((n, n))
    np.fill_diagonal(near, 0.0)
    region = np.zeros(n, int)
    sums, cost, size = np.zeros((k, n)), np.zeros(k), np.zeros(k, int)
    feasible = np.zeros((k, n), bool)

    def add(r: int, v: int) -> None:
        cost[r] = (size[r] * cost[r] + sums[r, v]) / (size[r] + 1)
        size[r] += 1
        region[v] = r + 1
        sums[r] += near[v]
        feasible[:, v] = False
        for b, _ in graph.neighbours[v]:
            feasible[r, b] = region[b] == 0

    chosen = seeds(genes[pairs:], k).tolist()
    for r, s in enumerate(chosen):
        add(r, s)
    for s in chosen:
        feasible[:, s] = False
    while feasible.any():
        value = np.where(feasible, (sums - cost[:, None]) / (size[:, None] + 1), np.inf)
        r, v = divmod(int(np.argmin(value)), n)  # the first minimum in order of (region, node)
        if trace is not None:
            trace.append((r + 1, v, float(value[r, v]), float(cost.sum())))
        add(r, v)
    return region


def objective(graph: Graph, region: np.ndarray) -> float:
    """Squared distances to the centroids of the regions; nodes in region 0 count for nothing."""
    total = 0.0
    for r in np.unique(region[region > 0]):
        part = graph.x[region == r]
        total += float(((part - part.mean(axis=0)) ** 2).sum())
    return total


def contiguous(graph: Graph, region: np.ndarray) -> bool:
    """Whether every region hangs together."""
    inside = [e for e in range(graph.m) if region[graph.u[e]] == region[graph.v[e]]]
    return len(set(components(graph, inside).tolist())) == len(set(region.tolist()))


DECODERS = {"mst": decode_mst, "shortest": decode_shortest, "greedy": decode_greedy}


def chromosome_length(method: str, n: int, m: int) -> int:
    return {"mst": 2 * m, "shortest": m + n, "greedy": n * (n - 1) // 2 + n}[method]
