"""Low-rank factorizations of kernel matrices and regression with them.

A factor is a table (id, p, l array<double>) with K ~ L L^T, and the list of pivots in order. Rows stay distributed;
the driver only sees the pivot rows and r x r matrices. Rows meet by merge joins: by the size of compressed files a few
columns of all points can seem small enough to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.functions.distances import dot
from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.session import cut


@dataclass
class Factor:
    rows: DataFrame
    pivots: list[int]
    traces: list[float]
    pivot_rows: np.ndarray

    def gram(self) -> np.ndarray:
        """L^T L by partial sums in the tasks."""
        return gram(self.rows.select(F.col("l").alias("a")), len(self.pivots))

    def biorthogonal(self) -> np.ndarray:
        """Rows at the pivots of B with B^T L = I; B is zero elsewhere."""
        return np.linalg.inv(self.pivot_rows).T

    def spectral_weights(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of L L^T, descending, and the weights U with (L U) orthogonal columns of those squared norms."""
        value, vector = np.linalg.eigh(self.gram())
        return value[::-1], vector[:, ::-1]


def gram(rows: DataFrame, r: int) -> np.ndarray:
    """Sum of a a^T over all rows."""

    def partial(frames):
        total = np.zeros((r, r))
        for f in frames:
            if len(f):
                a = np.array(f["a"].tolist())
                total += a.T @ a
        i, j = np.indices((r, r))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    out = np.zeros((r, r))
    for i, j, v in rows.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # r * r rows
        out[i, j] = v
    return out


def pivoted_cholesky(points: DataFrame, kernel: CovarianceKernel, tol: float = 1e-3, max_rank: int = 100, values: str | None = None) -> Factor:
    """Greedy factorization: the pivot is the largest residual diagonal entry (smallest id on ties), or with ``values``
    the largest absolute residual of that column (orthogonal matching pursuit). Stops when the trace of the residual is
    at most ``tol`` times the first one, at a pivot that isn't positive, or at ``max_rank`` columns."""
    x = points.select("id", "p", kernel(F.col("p"), F.col("p")).alias("d"), F.array().cast("array<double>").alias("l"), (F.col(values).cast("double") if values else F.lit(0.0)).alias("res"))
    x = cut(x)
    pivots, traces, rows = [], [], []
    order = F.abs("res") if values else F.col("d")
    for _ in range(max_rank + 1):
        best = x.agg(F.max(F.struct(order.alias("o"), (-F.col("id")).alias("minus"), "p", "d", "l", "res")).alias("b"), F.sum("d").alias("t")).first()
        if best["b"] is None:
            break
        traces.append(best["t"])
        b = best["b"]
        if best["t"] <= tol * traces[0] or b["d"] <= 0 or len(pivots) == max_rank or (values and b["o"] <= 1e-14):
            break
        pivots.append(-b["minus"])
        root = float(np.sqrt(b["d"]))
        pl = F.array(*[F.lit(float(v)) for v in b["l"]]) if b["l"] else F.array().cast("array<double>")
        new = (kernel(F.col("p"), F.array(*[F.lit(float(v)) for v in b["p"]])) - dot(F.col("l"), pl)) / root
        x = x.withColumn("n", new).select("id", "p", (F.col("d") - F.col("n") * F.col("n")).alias("d"), F.concat("l", F.array("n")).alias("l"), (F.col("res") - F.col("n") * (b["res"] / root)).alias("res"))
        rows.append([*b["l"], root])
        x = cut(x)
    r = len(pivots)
    lp = np.zeros((r, r))
    for i, row in enumerate(rows):
        lp[i, : len(row)] = row
    return Factor(x, pivots, traces, lp)


def _product(points: DataFrame, kernel: CovarianceKernel, x: np.ndarray, at: dict, omega: np.ndarray, block: int = 2048) -> np.ndarray:
    """K omega, the rows of K in tasks and its columns in blocks; ``at`` has the row of each id."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((x, omega))

    def fn(frames):
        x, omega = shared.value
        for f in frames:
            for i in range(0, len(f), block):
                p = np.array(f["p"].iloc[i : i + block].tolist())
                y = sum(kernel.matrix(p, x[j : j + block]) @ omega[j : j + block] for j in range(0, len(x), block))
                yield pd.DataFrame({"id": f["id"].iloc[i : i + block].to_numpy(), "y": list(y)})

    out = np.zeros_like(omega)
    for row_id, y in points.select("id", "p").mapInPandas(fn, "id long, y array<double>").toLocalIterator():
        out[at[row_id]] = y
    shared.unpersist()
    return out


def truncated_eigen(points: DataFrame, kernel: CovarianceKernel, tol: float = 1e-3, limit: int = 5000) -> tuple[list[int], np.ndarray]:
    """Ids and factor of the truncated eigendecomposition, exact for at most ``limit`` points.

    More points go through a randomized range finder, K ~ Q (Q^T K Q) Q^T with Q a basis of K times a random matrix, whose
    number of columns doubles until the trace defect is at most ``tol``. K is never held; points and N x columns numbers
    are held by the driver and each task.
    """
    rows = points.orderBy("id").select("id", "p").collect()
    ids, x = [r["id"] for r in rows], np.array([r["p"] for r in rows])
    n = len(ids)
    if n <= limit:
        k = kernel.matrix(x, x)
        value, q = np.linalg.eigh(k)
        trace = np.trace(k)
    else:
        at = {i: k for k, i in enumerate(ids)}
        trace, r = n * float(kernel.values(np.zeros(1))[0]), min(n, 64)
        rng = np.random.default_rng(0)
        while True:
            q = np.eye(n) if r == n else rng.standard_normal((n, r))
            for _ in range(2 if r < n else 0):  # the second time sharpens slowly falling spectra
                q = np.linalg.qr(_product(points, kernel, x, at, q))[0]
            t = q.T @ _product(points, kernel, x, at, q)
            value, u = np.linalg.eigh((t + t.T) / 2)
            if value.sum() >= trace * (1 - tol) or r == n:
                q = q @ u
                break
            r = min(n, 2 * r)
    value, vector = value[::-1], q[:, ::-1]
    keep = int(np.searchsorted(np.cumsum(value), trace * (1 - tol)) + 1)
    return ids, vector[:, :keep] * np.sqrt(np.maximum(0, value[:keep]))


def centres(points: DataFrame, rank: int, seed: int = 0) -> tuple[list[int], np.ndarray]:
    """A sample of ``rank`` points, by seeded hash of their ids."""
    rows = points.select("id", "p").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rank).collect()
    return [r["id"] for r in rows], np.array([r["p"] for r in rows])


def _root(kernel: CovarianceKernel, c: np.ndarray, rank: int) -> np.ndarray:
    """Cholesky factor at the centres, one for training and prediction: in directions that the kernel hardly sees, factors
    of different shifts have nothing in common."""
    return np.linalg.cholesky(kernel.matrix(c, c) + 1e-12 * rank * np.eye(len(c)))


def nystrom(points: DataFrame, kernel: CovarianceKernel, rank: int, seed: int = 0) -> DataFrame:
    """``(id, p, l)`` with K ~ L L^T through ``rank`` centres."""
    _, c = centres(points, rank, seed)
    root = _root(kernel, c, rank)

    def fn(frames):
        for f in frames:
            if len(f):
                l = np.linalg.solve(root, kernel.matrix(np.array(f["p"].tolist()), c).T).T  # noqa: E741
                yield pd.DataFrame({"id": f["id"], "p": f["p"], "l": list(l)})

    return points.select("id", "p").mapInPandas(fn, "id long, p array<double>, l array<double>")


def low_rank_ridge(factor_rows: DataFrame, r: int, target: str, ridge: float) -> np.ndarray:
    """Coefficients w of the ridge regression f ~ L w, from (L, f)'s Gram matrix."""
    g = gram(factor_rows.select(F.concat("l", F.array(F.col(target).cast("double"))).alias("a")), r + 1)
    return np.linalg.solve(g[:r, :r] + ridge * np.eye(r), g[:r, r])


def predict(factor_rows: DataFrame, w: np.ndarray) -> DataFrame:
    return factor_rows.select("id", dot(F.col("l"), F.array(*[F.lit(float(v)) for v in w])).alias("prediction"))


@dataclass
class Falkon:
    """Ridge regression on M centres by preconditioned conjugate gradients; each step is one pass over the points."""

    points: DataFrame
    kernel: CovarianceKernel
    m: int
    ridge: float
    seed: int = 0

    def __post_init__(self):
        self.ids, self.c = centres(self.points, self.m, self.seed)
        kmm = self.kernel.matrix(self.c, self.c)
        m = len(self.c)
        self.t = np.linalg.cholesky(kmm + 2.3e-16 * m * np.eye(m)).T
        self.a = np.linalg.cholesky(self.t @ self.t.T / m + self.ridge * np.eye(m)).T
        self.n = self.points.count()

    def _pass(self, beta: np.ndarray | None, target: str | None) -> np.ndarray:
        """K_nM^T (K_nM beta), or K_nM^T f."""
        kernel, c = self.kernel, self.c

        def fn(frames):
            total = np.zeros(len(c))
            for f in frames:
                if len(f):
                    k = kernel.matrix(np.array(f["p"].tolist()), c)
                    total += k.T @ (k @ beta if target is None else f[target].to_numpy(dtype=float))
            yield pd.DataFrame({"i": np.arange(len(c)), "v": total})

        out = np.zeros(len(c))
        cols = ["p"] if target is None else ["p", target]
        for i, v in self.points.select(*cols).mapInPandas(fn, "i int, v double").groupBy("i").agg(F.sum("v")).collect():  # m rows
            out[i] = v
        return out

    def alpha(self, target: str, steps: int = 10, tol: float = 1e-12) -> np.ndarray:
        t, a = self.t, self.a
        solve = np.linalg.solve
        b = solve(a.T, solve(t.T, self._pass(None, target) / self.n))
        x, r = np.zeros_like(b), b.copy()
        p, rs = r.copy(), r @ r
        for _ in range(steps):
            if rs <= tol * tol * (b @ b):
                break
            u = solve(a, p)
            ap = solve(a.T, solve(t.T, self._pass(solve(t, u), None)) / self.n + self.ridge * u)
            step = rs / (p @ ap)
            x, r = x + step * p, r - step * ap
            p, rs = r + (r @ r) / rs * p, r @ r
        return solve(t, solve(a, x))

    def predict(self, points: DataFrame, alpha: np.ndarray) -> DataFrame:
        kernel, c = self.kernel, self.c

        def fn(frames):
            for f in frames:
                if len(f):
                    yield pd.DataFrame({"id": f["id"], "prediction": kernel.matrix(np.array(f["p"].tolist()), c) @ alpha})

        return points.select("id", "p").mapInPandas(fn, "id long, prediction double")


def conditional_mean(points: DataFrame, x: str, y: str, kernel: CovarianceKernel, sites: np.ndarray, rank: int, ridge: float) -> np.ndarray:
    """E[y | x = site] by a low-rank conditional mean embedding: columns ``x`` (array) and ``y`` (double)."""
    base = points.select("id", F.col(x).alias("p"), F.col(y).alias("y"))
    _, c = centres(base, rank)
    l = nystrom(base, kernel, rank).join(base.select("id", "y").hint("merge"), "id")  # noqa: E741
    n = base.count()
    w = low_rank_ridge(l, len(c), "y", ridge * n)
    root = _root(kernel, c, rank)
    return np.linalg.solve(root, kernel.matrix(sites, c).T).T @ w


def gaussian_process(points: DataFrame, kernel: CovarianceKernel, target: str, noise: float, sites: DataFrame, rank: int) -> DataFrame:
    """``(id, mean, variance)`` at ``sites`` from a Nystrom factor of the training points."""
    _, c = centres(points, rank)
    root = _root(kernel, c, rank)
    g = gram(nystrom(points, kernel, rank).join(points.select("id", target).hint("merge"), "id").select(F.concat("l", F.array(F.col(target).cast("double"))).alias("a")), len(c) + 1)
    r = len(c)
    inner = np.linalg.inv(g[:r, :r] + noise * np.eye(r))
    w = inner @ g[:r, r]

    def fn(frames):
        for f in frames:
            if len(f):
                p = np.array(f["p"].tolist())
                l = np.linalg.solve(root, kernel.matrix(p, c).T).T  # noqa: E741
                prior = np.array([kernel.values(np.zeros(1))[0]] * len(p))
                yield pd.DataFrame({"id": f["id"], "mean": l @ w, "variance": prior - (l * l).sum(1) + noise * ((l @ inner) * l).sum(1)})

    return sites.select("id", "p").mapInPandas(fn, "id long, mean double, variance double")
