"""Nearest-neighbour and radius joins on point sets ``(id long, p array<double>)``.

In low dimension the joins run over grid cells: a range join is an equi-join of each point's cell with the cells around
it plus the exact predicate. In high dimension every pair of blocks of points is compared in one vectorised task; the
blocks are cut by hash, so nothing is broadcast and no task grows with the input.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scatterspark.functions.distances import distance, euclidean
from scatterspark.session import cut

BLOCK = 4096


def _pairs_in_blocks(a: DataFrame, b: DataFrame, rows_a: int, rows_b: int) -> DataFrame:
    """Both sides replicated to the grid of block pairs: (bi, bj, side, id, p)."""
    na, nb = max(1, math.ceil(rows_a / BLOCK)), max(1, math.ceil(rows_b / BLOCK))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = a.select(F.pmod(F.xxhash64("id"), F.lit(na)).alias("bi"), F.explode(every(nb)).alias("bj"), F.lit(0).alias("side"), "id", "p")
    right = b.select(F.explode(every(na)).alias("bi"), F.pmod(F.xxhash64("id"), F.lit(nb)).alias("bj"), F.lit(1).alias("side"), "id", "p")
    return left.unionByName(right)


def knn(points: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """``(i, rank, j, dist)``: the k nearest other points of every point, exactly; ties broken by id."""
    distance(metric)
    n = points.count()
    geodesic = metric.upper() == "GEODESIC"

    def block(part: pd.DataFrame) -> pd.DataFrame:
        q, c = part[part["side"] == 0], part[part["side"] == 1].sort_values("id")
        if not len(q) or not len(c):
            return pd.DataFrame({"i": [], "j": [], "dist": []})
        x, y, yid = np.array(q["p"].tolist()), np.array(c["p"].tolist()), c["id"].to_numpy()
        out = []
        for lo in range(0, len(x), 256):
            xs, ids = x[lo : lo + 256], q["id"].to_numpy()[lo : lo + 256]
            if geodesic:
                d = np.arccos(np.clip(xs @ y.T, -1, 1))
            else:
                rough = (xs**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * xs @ y.T
                d = np.sqrt(np.maximum(0, rough))
            d[ids[:, None] == yid[None, :]] = np.inf
            kk = min(k + 8, len(yid))
            near = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            if not geodesic:  # the shortlist again, in the exact form
                exact = np.sqrt(((xs[:, None, :] - y[near]) ** 2).sum(-1))
                exact[~np.isfinite(np.take_along_axis(d, near, 1))] = np.inf
                cut = np.take_along_axis(d, near, 1).max(1)
                kth = np.sort(exact, 1)[:, min(k, kk) - 1]
                for r in np.flatnonzero(cut <= kth + 1e-6):  # many ties: compare all
                    full = np.sqrt(((y - xs[r]) ** 2).sum(1))
                    full[yid == ids[r]] = np.inf
                    best = np.lexsort((yid, full))[:k]
                    out.append((np.full(len(best), ids[r]), yid[best], full[best]))
                    exact[r] = np.inf
            else:
                exact = np.take_along_axis(d, near, 1)
            for r in range(len(ids)):
                best = np.lexsort((yid[near[r]], exact[r]))[:k]
                best = best[np.isfinite(exact[r][best])]
                out.append((np.full(len(best), ids[r]), yid[near[r][best]], exact[r][best]))
        f = pd.DataFrame({"i": np.concatenate([o[0] for o in out]), "j": np.concatenate([o[1] for o in out]), "dist": np.concatenate([o[2] for o in out])})
        return f[np.isfinite(f["dist"])]

    found = _pairs_in_blocks(points, points, n, n).groupBy("bi", "bj").applyInPandas(block, "i long, j long, dist double")
    w = Window.partitionBy("i").orderBy("dist", "j")  # at most k rows from each block
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("i", "rank", "j", "dist")


def sym_knn(points: DataFrame, k: int = 1, rule: str = "larger", metric: str = "euclidean") -> DataFrame:
    """Symmetric neighbour edges ``(i, j, dist)``.

    ``larger``: {a, b} with a < b is an edge if a is among b's neighbours; ``union``: if either is; ``mutual``: if both are.
    """
    e = knn(points, k, metric).select("i", "j", "dist")
    if rule == "larger":
        half = e.where("j < i")
    elif rule in ("union", "mutual"):
        half = e.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "dist").groupBy("i", "j").agg(F.min("dist").alias("dist"), F.count("*").alias("n"))
        half = half.where(F.col("n") >= (2 if rule == "mutual" else 1)).drop("n")
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return half.union(half.select("j", "i", "dist"))


def _cell(c: Column, eps: float) -> Column:
    return F.floor(c / eps)


def _range_pairs(a: DataFrame, b: DataFrame, eps: float, dim: int, cells: int = 3) -> DataFrame:
    """Pairs (i, pi, j, pj) that may be closer than eps, from a grid over the first ``cells`` coordinates."""
    d = min(dim, cells)
    key = [f"c{x}" for x in range(d)]
    left = a.select(F.col("id").alias("i"), F.col("p").alias("pi"), *[_cell(F.element_at("p", x + 1), eps).alias(key[x]) for x in range(d)])
    right = b.select(F.col("id").alias("j"), F.col("p").alias("pj"), *[_cell(F.element_at("p", x + 1), eps).alias(key[x]) for x in range(d)])
    for x in range(d):
        right = right.withColumn(key[x], F.explode(F.array(F.col(key[x]) - 1, F.col(key[x]), F.col(key[x]) + 1)))
    return left.join(right.hint("merge"), key).select("i", "pi", "j", "pj")  # sizes are estimated without the explode


def _places(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct places ``(id, p, m)``, held by m points each, and the place of each point, ``(id, place)``."""
    places = cut(points.groupBy("p").agg(F.count("*").alias("m")).withColumn("place", F.monotonically_increasing_id()))
    own = cut(points.select("id", "p").join(places.hint("merge"), "p").select("id", "place"))
    return places.select(F.col("place").alias("id"), "p", "m"), own


def eps_counts(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """``(q, n)``: the number of points strictly closer than eps to each point, itself included. Only places are compared."""
    places, own = _places(points)
    near = eps_nn(places.select("id", "p"), places.select("id", "p"), eps, dim)
    n = near.join(places.select(F.col("id").alias("j"), "m"), "j").groupBy(F.col("q").alias("place")).agg(F.sum("m").alias("n"))
    return own.join(n, "place").select(F.col("id").alias("q"), "n")


def eps_nn(points: DataFrame, queries: DataFrame, eps: float, dim: int) -> DataFrame:
    """``(q, j, dist)``: points strictly closer than eps to each query point ``(id, p)``."""
    pairs = _range_pairs(queries, points, eps, dim).select(F.col("i").alias("q"), "j", euclidean(F.col("pi"), F.col("pj")).alias("dist"))
    return pairs.where(F.col("dist") < eps)


def sym_eps_nn(points: DataFrame, eps: float, dim: int) -> DataFrame:
    """``(i, j, dist)`` in both directions, without self pairs, strictly closer than eps."""
    places, own = _places(points)
    places = places.select("id", "p")
    near = eps_nn(places, places, eps, dim)  # a place and itself, too: points that coincide
    a, b = own.select(F.col("id").alias("i"), F.col("place").alias("q")), own.select(F.col("id").alias("j2"), F.col("place").alias("j"))
    pairs = near.join(a.hint("merge"), "q").join(b.hint("merge"), "j").select("i", F.col("j2").alias("j"), "dist")
    return pairs.where("i != j")


def min_distance(points: DataFrame) -> DataFrame:
    """``(id, dist)``: distance to the nearest other point (0 for duplicates)."""
    return knn(points, 1).select(F.col("i").alias("id"), "dist")


def projection_buckets(points: DataFrame, dim: int, levels: int, seed: int) -> DataFrame:
    """Leaves of a random projection tree: at each level the median of a seeded direction of the node splits it."""
    x = points.select("id", "p", F.lit(1).cast("long").alias("path"))
    uniform = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("path"), i), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 0))) * F.cos(2 * math.pi * uniform(i, 1))
    for level in range(levels):
        if level % 2 == 0:
            x = cut(x)  # each level reads the one before twice
        x = x.withColumn("t", F.aggregate(F.transform("p", lambda v, i: v * normal(i)), F.lit(0.0), lambda s, v: s + v))
        mid = x.groupBy("path").agg(F.percentile_approx("t", 0.5, 10000).alias("mid"))
        x = x.join(mid, "path").select("id", "p", (F.col("path") * 2 + (F.col("t") > F.col("mid")).cast("long")).alias("path"))
    return cut(x)


def approximate_sym_knn(points: DataFrame, dim: int, k: int = 1, leaf_size: int = 100, n_trees: int = 10, seed: int = 0) -> DataFrame:
    """Neighbour edges from the leaves of several random projection trees; the edge rule is that of ``sym_knn``."""
    levels = max(0, math.ceil(math.log2(max(1, points.count() / leaf_size))))
    found = None
    for t in range(n_trees):
        x = projection_buckets(points, dim, levels, seed + t)
        a, b = x.select(F.col("id").alias("i"), F.col("p").alias("pi"), "path"), x.select(F.col("id").alias("j"), F.col("p").alias("pj"), "path")
        e = a.join(b, "path").where("i != j").select("i", "j", euclidean(F.col("pi"), F.col("pj")).alias("dist"))
        found = e if found is None else found.union(e)
    best = found.dropDuplicates(["i", "j"]).withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("dist", "j"))).where(F.col("rank") <= k)
    half = best.where("j < i").select("i", "j", "dist")
    return half.union(half.select("j", "i", "dist"))


def fast_min_distance(points: DataFrame, dim: int, samples: int = 10, leaf_size: int = 300, seed: int = 0) -> DataFrame:
    """Upper bound of ``min_distance`` from the leaves of random projection trees; ``(id, dist)``."""
    levels = max(0, math.ceil(math.log2(max(1, points.count() / leaf_size))))
    found = None
    for t in range(samples):
        x = projection_buckets(points, dim, levels, seed + t)
        a, b = x.select(F.col("id").alias("i"), F.col("p").alias("pi"), "path"), x.select(F.col("id").alias("j"), F.col("p").alias("pj"), "path")
        e = a.join(b, "path").where("i != j").groupBy(F.col("i").alias("id")).agg(F.min(euclidean(F.col("pi"), F.col("pj"))).alias("dist"))
        found = e if found is None else found.union(e)
    return found.groupBy("id").agg(F.min("dist").alias("dist"))
