"""Sparse matrices as triplets (i, j, v): products, conjugate gradients, local inverses, l1 problems."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators.neighbours import _places, eps_nn
from scatterspark.session import cut


def multiply(a: DataFrame, x: DataFrame) -> DataFrame:
    """``(i, y)``: A x for ``x(j, x)``."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def conjugate_gradients(a: DataFrame, b: DataFrame, ridge: float = 0.0, tol: float = 1e-8, max_steps: int = 200) -> tuple[DataFrame, list[float]]:
    """Solves (A + ridge I) x = b for symmetric positive A and ``b(i, b)``, with Jacobi scaling; returns ``(i, x)`` and
    the relative residuals. The state is one narrow row an unknown; at most ``max_steps`` steps."""
    diag = a.where("i = j").select("i", (F.col("v") + ridge).alias("d"))
    s = b.join(diag, "i", "left").select("i", "b", F.coalesce("d", F.lit(1.0)).alias("d"))
    s = cut(s.select("i", "d", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("d")).alias("p")))
    norm = s.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("p"))).first()
    rz, history = norm[1], []
    for _ in range(max_steps):
        if not norm[0] or rz is None:
            break
        y = multiply(a, s.select(F.col("i").alias("j"), F.col("p").alias("x")))
        t = cut(s.join(y, "i", "left").withColumn("ap", F.coalesce("y", F.lit(0.0)) + ridge * F.col("p")))
        step = rz / t.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
        t = t.select("i", "d", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("ap")).alias("r"), "p")
        now = t.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("r") / F.col("d"))).first()
        history.append(math.sqrt(now[0] / norm[0]))
        s = cut(t.select("i", "d", "x", "r", (F.col("r") / F.col("d") + now[1] / rz * F.col("p")).alias("p")))
        rz = now[1]
        if history[-1] < tol:
            break
    return s.select("i", "x"), history


def search_radius(fill: float, fps: float = 1.0) -> float:
    """fps * h * |ln h| for the fill distance h."""
    return fps * fill * abs(math.log(fill))


def local_inverse_of_places(points: DataFrame, kernel: CovarianceKernel, radius: float, dim: int, ridge: float = 0.0, root: bool = False) -> tuple[DataFrame, DataFrame]:
    """``local_inverse`` in a short form: ``(a, b, m, v, own)`` for each distinct place a and the places b around it, and
    the place of each point, ``(id, place)``. The entry of points i at a and j at b is v, and v + own where i = j; m is the
    number of points at b.

    With E the indicator of the points' places and M = diag(m), the neighbourhood's matrix E K E^T + ridge I is
    S = M^1/2 K M^1/2 + ridge I on the span of E M^-1/2, and ridge I on the rest; only S is factored.
    """
    places, at = _places(points)
    near = eps_nn(places.select("id", "p"), places.select("id", "p"), radius, dim).select(F.col("q").alias("a"), F.col("j").alias("b"))
    near = near.join(places.select(F.col("id").alias("b"), "p", "m").hint("merge"), "b")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("b")
        a, p, m = g["a"].iloc[0], np.array(g["p"].tolist()), g["m"].to_numpy()
        w = np.sqrt(m)
        k = w[:, None] * kernel.matrix(p, p) * w + ridge * np.eye(len(p))
        here = g["b"].to_numpy() == a
        e, copies = here / w, m[here][0]
        if root:
            value, vector = np.linalg.eigh(k)
            inv = np.where(value > 2.3e-16, 1 / np.sqrt(np.maximum(value, 2.3e-16)), 0)
            v = vector @ (inv * (vector.T @ e))
            rest = 1 / math.sqrt(ridge) if ridge > 2.3e-16 else 0.0
        else:
            if ridge == 0 and m.max() > 1:
                raise np.linalg.LinAlgError("Singular matrix: points coincide")
            v = np.linalg.solve(k, e)
            rest = 1 / ridge if copies > 1 else 0.0
        own = rest if copies > 1 else 0.0
        return pd.DataFrame({"a": a, "b": g["b"], "m": m, "v": v / w - own / copies * here, "own": own * here})

    return near.groupBy("a").applyInPandas(solve, "a long, b long, m long, v double, own double"), at


def local_inverse(points: DataFrame, kernel: CovarianceKernel, radius: float, dim: int, ridge: float = 0.0, root: bool = False) -> DataFrame:
    """``(i, j, v)``: for each point the row of the inverse (or of its square root) of the kernel matrix of its
    neighbourhood. Every neighbourhood is solved by itself; points that coincide share one solution."""
    rows, at = local_inverse_of_places(points, kernel, radius, dim, ridge, root)
    i, j = at.select(F.col("id").alias("i"), F.col("place").alias("a")), at.select(F.col("id").alias("j"), F.col("place").alias("b"))
    pairs = rows.join(i.hint("merge"), "a").join(j.hint("merge"), "b")
    return pairs.select("i", "j", (F.col("v") + F.when(F.col("i") == F.col("j"), F.col("own")).otherwise(0.0)).alias("v"))


def soft_shrinkage(x: Column, w: float | Column) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - w, F.lit(0.0))


def semismooth_newton(a: np.ndarray, b: np.ndarray, w: np.ndarray, steps: int = 100, tol: float = 1e-10) -> np.ndarray:
    """Minimises 0.5 |b - A x|^2 + w . |x| for a small dense A, with the active set solved exactly; a damped step is
    taken where the full one doesn't lower the objective."""
    x = np.zeros(a.shape[1])
    gamma = 1 / np.linalg.norm(a, 2) ** 2
    cost = lambda z: 0.5 * ((b - a @ z) ** 2).sum() + w @ np.abs(z)
    shrink = lambda u: np.sign(u) * np.maximum(np.abs(u) - gamma * w, 0)
    for _ in range(steps):
        u = x - gamma * (a.T @ (a @ x - b))
        if np.abs(x - shrink(u)).max() < tol:
            break
        active = np.abs(u) > gamma * w
        new = np.zeros_like(x)
        if active.any():
            m = a[:, active]
            new[active] = np.linalg.lstsq(m.T @ m, m.T @ b - w[active] * np.sign(u[active]), rcond=None)[0]
        x = new if cost(new) < cost(x) else shrink(u)
    return x


def power_iteration(a: DataFrame, start: DataFrame, steps: int = 20) -> float:
    """Largest eigenvalue of a symmetric matrix from ``start(j, x)``."""
    x, value = start, 0.0
    for _ in range(steps):
        y = cut(multiply(a, x))
        norm = math.sqrt(y.agg(F.sum(F.col("y") * F.col("y"))).first()[0])
        if norm == 0:
            return 0.0
        value, x = norm, y.select(F.col("i").alias("j"), (F.col("y") / norm).alias("x"))
    return value
