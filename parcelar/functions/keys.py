"""Portable random keys: pure functions of (seed, generation, chromosome, gene).

The same integer recipe exists as SQL text, for any engine with 64-bit integers, and as numpy, so keys
don't depend on partitioning and kernels can make them where they are needed.  No product exceeds 2^62.
"""

from __future__ import annotations

import numpy as np

#: The Mersenne prime 2^31 - 1.
P = 2147483647


def place_sql(generation: str, chrom: str, gene: str) -> str:
    """SQL: one number below P for a gene of a chromosome of a generation."""
    return f"((((CAST({generation} AS BIGINT) % {P}) * 16807 + {chrom}) % {P}) * 48271 + {gene}) % {P}"


def key_sql(seed: str, place: str) -> str:
    """SQL: a uniform key in [0, 1) for a place."""
    h0 = f"(({place}) * 7919 + ({seed}) * 104729 + 13) % {P}"
    h1 = f"(({h0}) * 48271 + 11) % {P}"
    h2 = f"(({h1}) * ({h1}) + 12345) % {P}"
    return f"CAST(((({h2}) * 16807) + ({place}) * 69621 + 7) % {P} AS DOUBLE) / CAST({P} AS DOUBLE)"


def keys(seed: int, generation: int, chrom: np.ndarray | int, gene: np.ndarray) -> np.ndarray:
    """The same keys as :func:`key_sql`, broadcast over chromosomes and genes."""
    chrom, gene = np.asarray(chrom, np.int64), np.asarray(gene, np.int64)
    i = ((((generation % P) * 16807 + chrom) % P) * 48271 + gene) % P
    h0 = (i * 7919 + seed * 104729 + 13) % P
    h1 = (h0 * 48271 + 11) % P
    h2 = (h1 * h1 + 12345) % P
    return ((h2 * 16807 + i * 69621 + 7) % P) / float(P)


#: Gene numbers from which a child's own draws come, beyond any chromosome: parents, then one per gene.
ELITE_DRAW, OTHER_DRAW, CROSS_DRAW = 1_000_000_007, 1_000_000_009, 1_100_000_000
