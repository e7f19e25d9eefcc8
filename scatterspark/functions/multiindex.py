"""Multi-index sets, combination weights and mixed-radix arithmetic.

Sets are small and enumerated on the driver; ``frame`` makes them a table.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def total_degree(d: int, q: float, weights: list[float] | None = None) -> list[tuple[int, ...]]:
    """Indices with sum w_k a_k <= q, by degree and then lexicographically; weights default to 1."""
    w = weights or [1.0] * d
    out: list[tuple[int, ...]] = []

    def grow(prefix: tuple[int, ...], left: float):
        if len(prefix) == d:
            out.append(prefix)
            return
        k = 0
        while k * w[len(prefix)] <= left + 1e-12:
            grow((*prefix, k), left - k * w[len(prefix)])
            k += 1

    grow((), q)
    return sorted(out, key=lambda a: (sum(a), a))


def tensor_product(d: int, q: int) -> list[tuple[int, ...]]:
    return sorted(itertools.product(range(q + 1), repeat=d), key=lambda a: (sum(a), a))


def combination(indices: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int]]:
    """Combination-technique weights: sum of (-1)^|z| over z in {0,1}^d with a + z in the set; zeros left out."""
    members = set(indices)
    out = []
    for a in indices:
        c = sum((-1) ** sum(z) for z in itertools.product((0, 1), repeat=len(a)) if tuple(x + y for x, y in zip(a, z)) in members)
        if c:
            out.append((a, c))
    return out


def frame(spark: SparkSession, indices: list[tuple[int, ...]]) -> DataFrame:
    return spark.createDataFrame([(i, list(a)) for i, a in enumerate(indices)], "pos long, alpha array<int>")


def to_scalar(alpha: Column, extents: list[int]) -> Column:
    """Mixed-radix number of a multi-index, the first entry fastest."""
    out, below = F.lit(0).cast("long"), 1
    for k, n in enumerate(extents):
        out = out + F.element_at(alpha, k + 1).cast("long") * below
        below *= n
    return out


def to_multi(i: Column, extents: list[int]) -> Column:
    cols, below = [], 1
    for n in extents:
        cols.append((F.floor(i / below) % n).cast("int"))
        below *= n
    return F.array(*cols)


def binomial(n: int, k: int) -> int:
    return math.comb(n, k)


def multinomial(alpha: list[int], beta: list[int]) -> int:
    return math.prod(math.comb(a, b) for a, b in zip(alpha, beta))
