"""Hierarchical matrices: block patterns by refinement, low-rank blocks by adaptive cross approximation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterspark.functions import geometry
from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.session import cut

CHECKS = 32


def block_pattern(nodes: DataFrame, eta: float = 0.8, distance=geometry.ball_distance, max_levels: int = 60) -> DataFrame:
    """``(ra, rb, kind, na, nb)``: pairs of nodes ``(path, n, lo, hi, leaf)`` of one tree, refined from the root pair
    until they are admissible (low_rank) or one of them is a leaf (dense). One join a level."""
    side = lambda s: nodes.select(*[F.col(c).alias(f"{c}{s}") for c in ("path", "n", "lo", "hi", "leaf")])
    front = side("a").where("patha = 1").crossJoin(side("b").where("pathb = 1"))  # one pair
    done = None
    for _ in range(max_levels):
        x = cut(front.withColumn("kind", geometry.compare_cluster("a", "b", eta, distance)))
        out = x.where(F.col("kind") != geometry.REFINE).select(F.col("patha").alias("ra"), F.col("pathb").alias("rb"), "kind", F.col("na").alias("na"), F.col("nb").alias("nb"))
        done = out if done is None else done.union(out)
        more = x.where(F.col("kind") == geometry.REFINE).select(F.col("patha").alias("fa"), F.col("pathb").alias("fb"))
        if more.isEmpty():
            return done
        sons = lambda f, s: F.explode(F.array(F.col(f) * 2, F.col(f) * 2 + 1)).alias(s)
        pairs = more.select("fb", sons("fa", "patha")).select("patha", sons("fb", "pathb"))
        front = pairs.join(side("a"), "patha").join(side("b"), "pathb")
    raise RuntimeError("block pattern deeper than max_levels")


def aca(entry_rows, entry_cols, m: int, n: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive cross approximation A ~ L R^T with partial pivoting; ``entry_rows(i)`` and ``entry_cols(j)`` give rows
    and columns of A. A step with |l| |r| <= tol |S|, or a row that is zero, only ends it if ``CHECKS`` other rows, others each
    time, agree: one small step says nothing about rows that its pivots don't see. Otherwise the worst of them is next."""
    left, right, row, norm2, k = np.zeros((m, 8)), np.zeros((n, 8)), 0, 0.0, 0
    used = np.zeros(m, dtype=bool)
    order = np.random.default_rng(0).permutation(m)
    rest = lambda i: entry_rows(i) - right[:, :k] @ left[i, :k]
    while k < min(m, n):
        r = rest(row)
        used[row] = True
        col = int(np.abs(r).argmax())
        small = abs(r[col]) < 2.3e-16
        if not small:
            r = r / r[col]
            l = entry_cols(col) - left[:, :k] @ right[col, :k]  # noqa: E741
            size = np.linalg.norm(l) * np.linalg.norm(r)
            norm2 += size**2 + 2 * ((l @ left[:, :k]) @ (r @ right[:, :k]))
            if k == left.shape[1]:
                left, right = np.pad(left, ((0, 0), (0, k))), np.pad(right, ((0, 0), (0, k)))
            left[:, k], right[:, k], k = l, r, k + 1
            small = size <= tol * np.sqrt(max(norm2, 0))
        if used.all():
            break
        if small:
            order = order[~used[order]]
            some, order = order[:CHECKS], np.roll(order, -CHECKS)
            off = [np.linalg.norm(rest(i)) for i in some]
            if max(off) * np.sqrt(m) <= max(tol * np.sqrt(max(norm2, 0)), 2.3e-16):
                break
            row = int(some[int(np.argmax(off))])
        else:
            row = int(np.where(used, -1.0, np.abs(l)).argmax())
    return left[:, :k], right[:, :k]


def truncated_svd(a: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """A ~ L R^T with relative Frobenius error at most tol."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    tail = np.sqrt(np.cumsum((s**2)[::-1])[::-1])
    k = int((tail > tol * tail[0]).sum()) if len(s) else 0
    return u[:, :k] * s[:k], v[:k].T


def product(kernel: CovarianceKernel, p: np.ndarray, q: np.ndarray, v: np.ndarray, entries: int = 1 << 20) -> np.ndarray:
    """K(p, q) v; of K only about ``entries`` numbers are held."""
    step = max(1, entries // max(1, len(q)))
    return np.concatenate([kernel.matrix(p[i : i + step], q) @ v for i in range(0, len(p), step)])


def places(members: DataFrame, x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and ``(id, x)`` with one point, the smallest id, for those of a leaf that coincide; their x are summed."""
    own = cut(members.join(x, "id").groupBy("path", "level", "p").agg(F.min("id").alias("id"), F.sum("x").alias("x")))
    return own.select("id", "p", "path", "level"), own.select("id", "x")


def everywhere(members: DataFrame, at: DataFrame, y: DataFrame) -> DataFrame:
    """``(id, y)`` of all members from those of the points ``at`` that stand for them."""
    y = at.select("path", "p", "id").join(y, "id").drop("id")
    return members.select("id", "path", "p").join(y, ["path", "p"]).select("id", "y")


def multiply(members: DataFrame, pattern: DataFrame, kernel: CovarianceKernel, x: DataFrame, tol: float = 1e-6) -> DataFrame:
    """``(id, y)``: K x for ``x(id, x)`` and a tree ``members(id, p, path, level)``; every block is made and applied in
    a task of its own, admissible ones in low rank."""
    up = F.transform(F.sequence(F.lit(0), F.col("level")), lambda k: F.floor(F.col("path") / F.pow(F.lit(2.0), k)).cast("long"))
    at, x = places(members, x)
    own = at.join(x, "id").select("id", "p", "x", F.explode(up).alias("node"))
    rows = pattern.join(own, F.col("ra") == F.col("node")).select("ra", "rb", "kind", F.lit(0).alias("side"), "id", "p", "x")
    cols = pattern.join(own, F.col("rb") == F.col("node")).select("ra", "rb", "kind", F.lit(1).alias("side"), "id", "p", "x")

    def block(g: pd.DataFrame) -> pd.DataFrame:
        r, c = g[g["side"] == 0], g[g["side"] == 1]
        p, q = np.array(r["p"].tolist()), np.array(c["p"].tolist())
        v = c["x"].to_numpy()
        if g["kind"].iloc[0] == geometry.LOW_RANK:
            left, right = aca(lambda i: kernel.matrix(p[i : i + 1], q)[0], lambda j: kernel.matrix(p, q[j : j + 1])[:, 0], len(p), len(q), tol)
            y = left @ (right.T @ v)
        else:
            y = product(kernel, p, q, v)
        return pd.DataFrame({"id": r["id"], "y": y})

    out = rows.union(cols).groupBy("ra", "rb").applyInPandas(block, "id long, y double")
    return everywhere(members, at, out.groupBy("id").agg(F.sum("y").alias("y")))


def statistics(pattern: DataFrame) -> DataFrame:
    """``(kind, blocks, entries)``."""
    return pattern.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum(F.col("na") * F.col("nb")).alias("entries"))
