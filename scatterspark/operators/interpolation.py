"""Polynomial interpolation on boxes, nested cluster bases and the matrix-free product of an H2 matrix.

A cluster's basis functions are the Lagrange polynomials of its box; the basis of a father restricted to a son's box is a
combination of the son's, so only leaves touch points: coefficients go up the tree through transfer matrices, admissible
blocks couple them by the kernel at interpolation points, and results come down again. Dense blocks remain between
leaves that are close.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.functions import geometry, polynomials
from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.functions.multiindex import total_degree
from scatterspark.operators.hmatrix import everywhere, places, product
from scatterspark.session import cut


class Interpolator:
    """Interpolation in the unit cube: ``points`` (k x d) and ``basis(x)``, the n x k values of their Lagrange functions."""

    def __init__(self, points: np.ndarray, functions):
        self.points, self._functions = points, functions
        self._inverse = np.linalg.inv(functions(points))

    def basis(self, x: np.ndarray) -> np.ndarray:
        return self._functions(x) @ self._inverse

    def in_box(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The points scaled to a box."""
        return lo + self.points * (hi - lo)

    def on_box(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Values at x of the Lagrange functions of a box; flat edges are kept from dividing by zero."""
        return self.basis((x - lo) / np.where(hi > lo, hi - lo, 1.0))


class TensorInterpolator(Interpolator):
    """(degree + 1)^d tensor Chebyshev nodes, barycentric."""

    def __init__(self, d: int, degree: int):
        self.nodes = polynomials.chebyshev_nodes(degree + 1)
        self.points = np.array(list(itertools.product(self.nodes, repeat=d)))

    def basis(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), 1))
        for k in range(x.shape[1]):
            own = polynomials.lagrange(x[:, k], self.nodes)
            out = (out[:, :, None] * own[:, None, :]).reshape(len(x), -1)
        return out


def _products(one, indices: np.ndarray):
    def functions(x: np.ndarray) -> np.ndarray:
        values = one(x, int(indices.max(initial=0)))
        return np.prod([values[:, k, indices[:, k]] for k in range(x.shape[1])], axis=0)

    return functions


def _set(d: int, degree: int, weights) -> np.ndarray:
    return np.array(total_degree(d, degree, weights)).reshape(-1, d)


def monomial_interpolator(d: int, degree: int, weights=None) -> Interpolator:
    """Monomials of total (or weighted) degree at the Leja points of their indices."""
    idx = _set(d, degree, weights)
    leja = polynomials.leja_points(int(idx.max(initial=0)) + 1)
    return Interpolator(leja[idx], _products(polynomials.monomials, idx))


def total_degree_interpolator(d: int, degree: int, weights=None) -> Interpolator:
    """Orthonormal Legendre products of total (or weighted) degree, at the Leja points of their indices."""
    idx = _set(d, degree, weights)
    leja = polynomials.leja_points(int(idx.max(initial=0)) + 1)
    return Interpolator(leja[idx], _products(polynomials.legendre, idx))


def interpolate_kernel(kernel: CovarianceKernel, interpolator: Interpolator, a: tuple, b: tuple) -> np.ndarray:
    """The kernel at the interpolation points of two boxes (lo, hi): the coupling matrix of a block."""
    return kernel.matrix(interpolator.in_box(*map(np.asarray, a)), interpolator.in_box(*map(np.asarray, b)))


def transfer(interpolator: Interpolator, son: tuple, father: tuple) -> np.ndarray:
    """Values of the father's Lagrange functions at the son's interpolation points."""
    return interpolator.on_box(interpolator.in_box(*map(np.asarray, son)), *map(np.asarray, father))


def block_kinds(pattern: DataFrame, rank: int) -> DataFrame:
    """The block pattern where admissible blocks stay dense unless rank^2 < na * nb."""
    worth = F.lit(rank * rank) < F.col("na") * F.col("nb")
    return pattern.withColumn("kind", F.when((F.col("kind") == geometry.LOW_RANK) & ~worth, F.lit(geometry.DENSE)).otherwise(F.col("kind")))


def statistics(pattern: DataFrame, rank: int) -> DataFrame:
    """``(low_rank, dense, entries, per_row, gb)``: numbers of blocks, stored numbers, also a row of the matrix, and their size."""
    low = F.col("kind") == geometry.LOW_RANK
    stored = F.when(low, F.lit(rank * rank)).otherwise(F.col("na") * F.col("nb"))
    # the blocks tile the square
    out = pattern.agg(F.count_if(low).alias("low_rank"), F.count_if(~low).alias("dense"), F.sum(stored).alias("entries"), F.sqrt(F.sum(F.col("na") * F.col("nb"))).alias("n"))
    return out.select("low_rank", "dense", "entries", (F.col("entries") / F.col("n")).alias("per_row"), (F.col("entries") * 8 / 1e9).alias("gb"))


def coefficients(members: DataFrame, nodes: DataFrame, interpolator: Interpolator, x: DataFrame, levels: int) -> DataFrame:
    """``(path, a)``: moments of ``x(id, x)`` against the basis of every node: leaves from points, fathers from sons."""
    own = members.join(x, "id").join(nodes.select("path", "lo", "hi"), "path").select("path", "level", "p", "x", "lo", "hi")

    def leaf(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = np.array(g["lo"].iloc[0]), np.array(g["hi"].iloc[0])
        a = interpolator.on_box(np.array(g["p"].tolist()), lo, hi).T @ g["x"].to_numpy()
        return pd.DataFrame({"path": [int(g["path"].iloc[0])], "a": [a]})

    done = cut(own.groupBy("path").applyInPandas(leaf, "path long, a array<double>"))
    front = done
    boxes = nodes.select("path", "lo", "hi")
    for _ in range(levels):
        up = front.where("path > 1").join(boxes, "path").withColumn("f", F.floor(F.col("path") / 2).cast("long"))
        up = up.join(boxes.select(F.col("path").alias("f"), F.col("lo").alias("flo"), F.col("hi").alias("fhi")), "f")

        def lift(g: pd.DataFrame) -> pd.DataFrame:
            a = sum(transfer(interpolator, (r.lo, r.hi), (r.flo, r.fhi)).T @ np.array(r.a) for r in g.itertuples())
            return pd.DataFrame({"path": [int(g["f"].iloc[0])], "a": [a]})

        front = cut(up.groupBy("f").applyInPandas(lift, "path long, a array<double>"))
        if front.isEmpty():
            break
        done = done.union(front)
    # leaves of different depth reach a father at different steps
    total = F.aggregate(F.collect_list("a"), F.array_repeat(F.lit(0.0), len(interpolator.points)), lambda s, a: F.zip_with(s, a, lambda u, v: u + v))
    return done.groupBy("path").agg(total.alias("a"))  # at most a row a step for each node


def multiply(members: DataFrame, nodes: DataFrame, pattern: DataFrame, kernel: CovarianceKernel, interpolator: Interpolator, x: DataFrame) -> DataFrame:
    """``(id, y)``: K x for ``x(id, x)``, a tree ``members(id, p, path, level)``, its ``nodes(path, level, n, lo, hi)`` and a
    block pattern; nothing of K is stored but what one task holds of a block."""
    levels = nodes.agg(F.max("level")).first()[0] or 0
    rank = len(interpolator.points)
    every = members
    members, x = places(members, x)
    boxes = nodes.select("path", "lo", "hi")
    pattern = cut(block_kinds(pattern, rank))
    a = coefficients(members, nodes, interpolator, x, levels)
    side = lambda c: boxes.select(F.col("path").alias(f"r{c}"), F.col("lo").alias(f"lo{c}"), F.col("hi").alias(f"hi{c}"))
    far = pattern.where(F.col("kind") == geometry.LOW_RANK).select("ra", "rb").join(a.withColumnRenamed("path", "rb"), "rb").join(side("a"), "ra").join(side("b"), "rb")

    def couple(frames):
        for f in frames:
            y = [interpolate_kernel(kernel, interpolator, (r.loa, r.hia), (r.lob, r.hib)) @ np.array(r.a) for r in f.itertuples()]
            yield pd.DataFrame({"path": f["ra"], "a": y})

    add = F.aggregate(F.collect_list("a"), F.array_repeat(F.lit(0.0), rank), lambda s, v: F.zip_with(s, v, lambda t, u: t + u))
    coupled = far.mapInPandas(couple, "path long, a array<double>").groupBy("path").agg(add.alias("a"))  # a row for each block of a cluster: few
    # every leaf gathers what its ancestors were given, through their polynomials at the leaf's points
    up = F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.floor(F.col("path") / F.pow(F.lit(2.0), k)).cast("long"))
    own = members.join(x, "id").select("id", "p", "x", "path", F.explode(up).alias("node"))
    given = own.select("id", "p", "node").join(coupled.join(boxes, "path").withColumnRenamed("path", "node"), "node")

    def down(frames):
        for f in frames:
            y = np.empty(len(f))
            for _, g in f.groupby("node"):
                k = f.index.get_indexer(g.index)
                y[k] = interpolator.on_box(np.array(g["p"].tolist()), np.array(g["lo"].iloc[0]), np.array(g["hi"].iloc[0])) @ np.array(g["a"].iloc[0])
            yield pd.DataFrame({"id": f["id"], "y": y})

    from_far = given.mapInPandas(down, "id long, y double")
    near = pattern.where(F.col("kind") != geometry.LOW_RANK).select("ra", "rb")
    rows = near.join(own, F.col("ra") == F.col("node")).select("ra", "rb", F.lit(0).alias("side"), "id", "p", "x")
    cols = near.join(own, F.col("rb") == F.col("node")).select("ra", "rb", F.lit(1).alias("side"), "id", "p", "x")

    def dense(g: pd.DataFrame) -> pd.DataFrame:
        r, c = g[g["side"] == 0], g[g["side"] == 1]
        y = product(kernel, np.array(r["p"].tolist()), np.array(c["p"].tolist()), c["x"].to_numpy())
        return pd.DataFrame({"id": r["id"], "y": y})

    close = rows.union(cols).groupBy("ra", "rb").applyInPandas(dense, "id long, y double")
    return everywhere(every, members, from_far.union(close).groupBy("id").agg(F.sum("y").alias("y")))
