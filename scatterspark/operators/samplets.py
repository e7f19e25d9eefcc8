"""Samplets: orthonormal multiresolution coefficients with vanishing moments on a cluster tree.

``basis`` returns the sparse transform T as rows (node, k, kind, id, v): coefficient k of a node is the sum of v * f(id).
Kind ``s`` are samplets (their moments up to degree q vanish), kind ``c`` the scaling coefficients of the root. Subtrees
of about ``SUBTREE`` points are built in one grouped task each; their scaling functions' moments, a few numbers a
subtree, make the nodes above them. Leaves of any size are halved down to a few points inside, so a point has a number
of entries that grows with the logarithm of its leaf; a leaf above the subtrees' level is dealt out to several tasks.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBTREE = 50_000


def multi_indices(d: int, q: int) -> list[tuple[int, ...]]:
    """Total degree up to q, by degree and then lexicographically."""
    return sorted((a for a in itertools.product(range(q + 1), repeat=d) if sum(a) <= q), key=lambda a: (sum(a), a))


def _moments(p: np.ndarray, c: np.ndarray, idx) -> np.ndarray:
    return np.array([np.prod((p - c) ** np.array(a), axis=1) for a in idx])


def _shift(delta: np.ndarray, idx) -> np.ndarray:
    """Matrix that turns moments about c into moments about c - delta: (x - c + delta)^a by the binomial theorem."""
    s = np.zeros((len(idx), len(idx)))
    for i, a in enumerate(idx):
        for j, b in enumerate(idx):
            if all(y <= x for x, y in zip(a, b)):
                s[i, j] = np.prod([math.comb(x, y) * t ** (x - y) for x, y, t in zip(a, b, delta)])
    return s


def _factor(m: np.ndarray):
    """Scaling and samplet columns of the orthogonal factor of m^T, and the scaling functions' moments."""
    k, n = m.shape
    if n <= k:
        return np.eye(n), np.zeros((n, 0)), m
    q, r = np.linalg.qr(m.T, mode="complete")
    sign = np.sign(q[np.abs(q).argmax(0), range(n)])
    q = q * sign
    return q[:, :k], q[:, k:], (r[:k] * sign[:k, None]).T


def _entries(m: np.ndarray):
    """(row, column, value) of what isn't zero."""
    i, k = np.nonzero(np.abs(m) > 1e-14)
    return i, k, m[i, k]


def _leaf(m: np.ndarray, starts: np.ndarray | None = None):
    """As ``_factor``, the samplets as entries: pieces of a few items are factored, their scaling functions two by two.
    With ``starts`` of runs of items that coincide, each run has one scaling function, which is constant on it."""
    size, found, cols = max(8, 2 * len(m)), [], 0

    def go(m, lo, hi, mid, size):
        nonlocal cols
        if hi - lo <= size:
            scal, samp, up = _factor(m[:, lo:hi])
        else:
            (a, ua), (b, ub) = mid(lo, hi)
            scal, samp, up = _factor(np.hstack([ua, ub]))
            n = a.shape[1]
            scal, samp = np.vstack([a @ scal[:n], b @ scal[n:]]), np.vstack([a @ samp[:n], b @ samp[n:]])
        i, k, v = _entries(samp)
        found.append((i + lo, k + cols, v))
        cols += samp.shape[1]
        return scal, up

    def halved(m, lo, hi, size):
        return go(m, lo, hi, lambda lo, hi: (halved(m, lo, (lo + hi) // 2, size), halved(m, (lo + hi) // 2, hi, size)), size)

    def by_runs(a, b):
        lo, hi = ends[a], ends[b]
        if b - a == 1 and hi - lo > 1:
            scal, up = halved(one, lo, hi, 8)
            return scal, m[:, lo : lo + 1] * up
        few = size if hi - lo == b - a else 0
        return go(m, lo, hi, lambda lo, hi: (by_runs(a, (a + b) // 2), by_runs((a + b) // 2, b)), few)

    if starts is None:
        scal, up = halved(m, 0, m.shape[1], size)
    else:
        one, ends = np.ones((1, m.shape[1])), [*starts.tolist(), m.shape[1]]
        scal, up = by_runs(0, len(starts))
    return scal, tuple(np.concatenate(x) for x in zip(*found)), up


def _build(nodes: dict, root: int, idx):
    """Bottom-up over heap paths. ``nodes``: path -> (centre, items, moments of the items, starts of ``_leaf``); items are functions by column.

    Returns samplets {path: (items, entries)} and the root's (centre, scaling columns, moments), all over all items.
    """
    samplets = {}

    def go(path):
        if path in nodes:
            c, items, m, starts = nodes[path]
            scal, samp, up = _leaf(m, starts)
            samplets[path] = (items, samp)
            return c, items, scal, up
        sons = [go(s) for s in (2 * path, 2 * path + 1) if s in present]
        c = np.mean([s[0] for s in sons], axis=0)
        m = np.hstack([_shift(s[0] - c, idx) @ s[3] for s in sons])
        scal, samp, up = _factor(m)
        items = np.concatenate([s[1] for s in sons])
        wide = np.zeros((len(items), m.shape[1]))
        r = k = 0
        for s in sons:
            wide[r : r + s[2].shape[0], k : k + s[2].shape[1]] = s[2]
            r, k = r + s[2].shape[0], k + s[2].shape[1]
        samplets[path] = (items, _entries(wide @ samp))
        return c, items, wide @ scal, up

    present = set()
    for p in nodes:
        while p >= root and p not in present:
            present.add(p)
            p //= 2
    return samplets, go(root)


def _near(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order in which the pieces of ``_leaf`` hold points near each other: halves along the widest side, again and again."""
    order = np.arange(len(p))

    def go(lo, hi):
        if hi - lo > 1:
            x = p[order[lo:hi]]
            axes = np.argsort(x.max(0) - x.min(0), kind="stable")
            order[lo:hi] = order[lo:hi][np.lexsort([ids[order[lo:hi]], *x.T[axes]])]
            if hi - lo > 8:
                go(lo, (lo + hi) // 2)
                go((lo + hi) // 2, hi)

    go(0, len(p))
    return order


def subtrees(members: DataFrame, subtree: int = SUBTREE) -> tuple[DataFrame, int]:
    """The members with the root of the subtree that one task builds (a part of the leaf, where that lies above), and the
    level of these roots."""
    n = members.count()
    top = max(0, math.ceil(math.log2(max(1, n / subtree))))
    up, down = F.pow(F.lit(2.0), F.col("level") - top), F.pow(F.lit(2.0), F.lit(top) - F.col("level")).cast("long")
    part = F.pmod(F.xxhash64("id"), down)  # of a leaf above the subtrees' level
    return members.withColumn("root", F.when(F.col("level") >= top, F.floor(F.col("path") / up)).otherwise(F.col("path") * down + part).cast("long")), top


def basis(members: DataFrame, d: int, q: int = 0, subtree: int = SUBTREE, near: bool = False) -> DataFrame:
    """Rows (node, k, kind, id, v) of the transform for a tree ``members(id, p, path, level)``.

    A leaf's points are halved by id, or with ``near`` by place: then matrices of near points have fewer coefficients, and
    a samplet either lies on one place, where it sums up to zero, or is constant on each place.
    """
    idx = multi_indices(d, q)
    x, top = subtrees(members, subtree)

    def rows(path, kind, items, entries, step=1, first=0):
        i, k, v = entries
        return pd.DataFrame({"node": path, "k": (k * step + first).astype("int32"), "kind": kind, "id": items[i], "v": v})

    def build(g: pd.DataFrame) -> pd.DataFrame:
        root = int(g["root"].iloc[0])
        nodes = {}
        for path, leaf in g.groupby("path"):
            leaf = leaf.sort_values("id")
            p = np.array(leaf["p"].tolist())
            starts = None
            if near:
                places, first, at = np.unique(p, axis=0, return_index=True, return_inverse=True)
                rank = np.argsort(_near(places, leaf["id"].to_numpy()[first]))[at.reshape(-1)]
                order = np.argsort(rank, kind="stable")
                leaf, p = leaf.iloc[order], p[order]
                starts = np.unique(rank[order], return_index=True)[1]
            c = (p.min(0) + p.max(0)) / 2
            nodes[int(path)] = (c, leaf["id"].to_numpy(), _moments(p, c, idx), starts)
        level, step, leaf = int(g["level"].iloc[0]), 1, root
        if level < top:  # a part of a leaf: numbers of its own
            step, leaf = 1 << top - level, int(g["path"].iloc[0])
            nodes = {root: nodes[leaf]}
        samplets, (c, items, scal, up) = _build(nodes, root, idx)
        out = [rows(leaf if step > 1 else p, "s", i, s, step, root % step) for p, (i, s) in samplets.items()] + [rows(root, "c", items, _entries(scal))]
        flat = np.concatenate([[leaf], c, up.ravel()])  # moments of the root's scaling functions, as rows of their own
        out.append(pd.DataFrame({"node": root, "k": range(len(flat)), "kind": "m", "id": up.shape[1], "v": flat}))
        return pd.concat(out).astype({"k": "int32"})

    schema = "node long, k int, kind string, id long, v double"
    low = x.groupBy("root").applyInPandas(build, schema)
    if top == 0:
        return low.where("kind != 'm'")
    from scatterspark.session import cut

    low = cut(low)

    def above(g: pd.DataFrame) -> pd.DataFrame:
        nodes, names, leaves = {}, [], set()
        for path, m in g.groupby("node"):
            v, cols = m.sort_values("k")["v"].to_numpy(), int(m["id"].iloc[0])
            nodes[int(path)] = (v[1 : d + 1], np.arange(len(names), len(names) + cols), v[d + 1 :].reshape(len(idx), cols))
            names += [(int(path), k) for k in range(cols)]
            if int(v[0]) != path:
                leaves.add(int(v[0]))
        samplets, (_, items, scal, _) = _build_above(nodes, idx)
        out, below = [], 0
        for path, kind, it, s in [(p, "s", i, s) for p, (i, s) in samplets.items()] + [(1, "c", items, scal)]:
            i, k, w = _entries(s)
            leaf = next((path >> n for n in range(path.bit_length()) if path >> n in leaves), None)
            if leaf and kind == "s":  # joins the parts of a leaf: its samplets' numbers go on below 0
                path, k, below = leaf, k - below - s.shape[1], below + s.shape[1]
            out.append(pd.DataFrame({"node": path, "k": k, "kind": kind, "root": [names[it[j]][0] for j in i], "rk": [names[it[j]][1] for j in i], "w": w}))
        f = pd.concat(out)
        return f.astype({"k": "int32", "rk": "int32"})

    high = low.where("kind = 'm'").groupBy("kind").applyInPandas(above, "node long, k int, kind string, root long, rk int, w double")  # a few numbers a subtree
    scaling = low.where("kind = 'c'").select(F.col("node").alias("root"), F.col("k").alias("rk"), "id", "v")
    lifted = high.join(scaling, ["root", "rk"]).groupBy("node", "k", "kind", "id").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return low.where("kind = 's'").union(lifted)


def _build_above(nodes: dict, idx):
    """Nodes above the subtree roots: their items are the roots' scaling functions, which stay as they are."""
    samplets = {}

    def go(path):
        if path in nodes:
            c, items, m = nodes[path]
            return c, items, np.eye(len(items)), m
        sons = [go(s) for s in (2 * path, 2 * path + 1) if s in present]
        c = np.mean([s[0] for s in sons], axis=0)
        m = np.hstack([_shift(s[0] - c, idx) @ s[3] for s in sons])
        scal, samp, up = _factor(m)
        items = np.concatenate([s[1] for s in sons])
        wide = np.zeros((len(items), m.shape[1]))
        r = k = 0
        for s in sons:
            wide[r : r + s[2].shape[0], k : k + s[2].shape[1]] = s[2]
            r, k = r + s[2].shape[0], k + s[2].shape[1]
        samplets[path] = (items, wide @ samp)
        return c, items, wide @ scal, up

    present = set()
    for p in nodes:
        while p >= 1 and p not in present:
            present.add(p)
            p //= 2
    return samplets, go(1)


def transform(t: DataFrame, data: DataFrame) -> DataFrame:
    """``(node, k, kind, c)``: coefficients of ``data(id, f)``."""
    return t.join(data, "id").groupBy("node", "k", "kind").agg(F.sum(F.col("v") * F.col("f")).alias("c"))


def inverse(t: DataFrame, coefficients: DataFrame) -> DataFrame:
    """``(id, f)`` from coefficients."""
    return t.join(coefficients, ["node", "k", "kind"]).groupBy("id").agg(F.sum(F.col("v") * F.col("c")).alias("f"))


def min_level_transform(t: DataFrame, data: DataFrame, min_level: int) -> DataFrame:
    """Coefficients of the nodes from ``min_level`` down; what lies above is left in the point domain as kind ``r``."""
    level = F.floor(F.log2(F.col("node").cast("double")))
    fine = t.where((F.col("kind") == "s") & (level >= min_level))
    c = transform(fine, data)
    detail = inverse(fine, c).withColumnRenamed("f", "g")
    rest = data.join(detail, "id", "left").select(F.col("id").alias("node"), F.lit(0).alias("k"), F.lit("r").alias("kind"), (F.col("f") - F.coalesce("g", F.lit(0.0))).alias("c"))
    return c.union(rest)


def inverse_min_level(t: DataFrame, coefficients: DataFrame, min_level: int) -> DataFrame:
    level = F.floor(F.log2(F.col("node").cast("double")))
    fine = inverse(t.where((F.col("kind") == "s") & (level >= min_level)), coefficients.where("kind = 's'"))
    rest = coefficients.where("kind = 'r'").select(F.col("node").alias("id"), F.col("c").alias("f"))
    return fine.union(rest).groupBy("id").agg(F.sum("f").alias("f"))


def node_energies(coefficients: DataFrame) -> DataFrame:
    """``(node, own, total)``: energy of a node's samplets (and of the scaling coefficients, which are the root's), and of
    its whole subtree."""
    own = coefficients.groupBy("node").agg(F.sum(F.col("c") * F.col("c")).alias("own"))
    up = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("node").cast("double"))).cast("int")), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("long"))
    total = own.select("own", F.explode(up).alias("node")).groupBy("node").agg(F.sum("own").alias("total"))
    return total.join(own, "node", "left").select("node", F.coalesce("own", F.lit(0.0)).alias("own"), "total")


def active_nodes(coefficients: DataFrame, threshold: float) -> DataFrame:
    """Nodes with a coefficient above threshold * the largest one, and all their ancestors."""
    m = coefficients.where("kind = 's'").groupBy("node").agg(F.max(F.abs("c")).alias("m"))
    top = m.agg((F.max("m") * threshold).alias("cut"))
    big = m.crossJoin(F.broadcast(top)).where("m > cut")  # one row
    up = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.col("node").cast("double"))).cast("int")), lambda k: F.floor(F.col("node") / F.pow(F.lit(2.0), k)).cast("long"))
    return big.select(F.explode(up).alias("node")).distinct()


def active_leaves(active: DataFrame) -> DataFrame:
    """Active nodes without an active son."""
    fathers = active.where("node > 1").select(F.floor(F.col("node") / 2).cast("long").alias("node")).distinct()
    return active.join(fathers, "node", "left_anti")


def adaptive_tree(energies: DataFrame, threshold: float, max_levels: int = 40) -> DataFrame:
    """``(node, etilde)`` of the kept nodes of the adaptive search: children get the modified energies of their father,
    nodes are taken by descending modified energy until what is left is below ``threshold``, siblings are completed."""
    from scatterspark.session import cut

    e = energies.select("node", "own", "total", (F.col("total") - F.col("own")).alias("sons"))
    front = cut(e.where("node = 1").withColumn("et", F.col("total")))
    found = front
    for _ in range(max_levels):
        q = F.col("sons") * F.col("et") / (F.col("total") + F.col("et") + 2.220446049250313e-16)
        father = front.select(F.col("node").alias("f"), q.alias("et"))
        front = cut(e.join(father, F.floor(F.col("node") / 2) == F.col("f")).select("node", "own", "total", "sons", "et"))
        if front.isEmpty():
            break
        found = found.union(front)
    taken = F.sum("et").over(Window.orderBy(F.desc("et"), "node").rowsBetween(Window.unboundedPreceding, -1))
    total = found.agg(F.sum("et").alias("all"))
    kept = found.withColumn("before", F.coalesce(taken, F.lit(0.0))).crossJoin(F.broadcast(total)).where(F.col("all") - F.col("before") >= threshold)  # one row
    fathers = kept.where("node > 1").select(F.floor(F.col("node") / 2).cast("long").alias("f")).distinct()
    more = found.join(fathers, F.floor(F.col("node") / 2) == F.col("f"), "left_semi").select("node", "et")
    return kept.select("node", "et").union(more).distinct()


def a_posteriori(triplets: DataFrame, threshold: float) -> DataFrame:
    """The triplets (i, j, v) without the largest set of smallest off-diagonal entries whose Frobenius norm stays below
    threshold * the total norm."""
    total = triplets.agg(F.sum(F.col("v") * F.col("v")).alias("t"))
    w = Window.orderBy(F.abs("v"), "i", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    off = triplets.where("i != j").withColumn("s", F.sum(F.col("v") * F.col("v")).over(w)).crossJoin(F.broadcast(total))  # one row
    kept = off.where(F.col("s") >= threshold * threshold * F.col("t")).select("i", "j", "v")
    return triplets.where("i = j").select("i", "j", "v").union(kept)


def a_posteriori_fast(triplets: DataFrame, threshold: float) -> DataFrame:
    """The triplets without the smallest decades of |v| whose Frobenius norm stays below threshold * the total norm; the
    diagonal counts in its decades but always stays. 17 sums decide, so no global sort is needed."""
    decade = F.greatest(F.lit(0), F.least(F.lit(16), F.when(F.col("v") == 0, F.lit(16)).otherwise(-F.floor(F.log10(F.abs("v")))))).cast("int")
    from scatterspark.session import cut

    x = cut(triplets.withColumn("decade", decade))  # read by the sums and by the cut
    sums = x.groupBy("decade").agg(F.sum(F.col("v") * F.col("v")).alias("s"))  # 17 rows
    tail = sums.withColumn("tail", F.sum("s").over(Window.orderBy(F.desc("decade"))))
    total = sums.agg(F.sum("s").alias("t"))
    gone = tail.crossJoin(F.broadcast(total)).where(F.col("tail") < threshold * threshold * F.col("t")).select("decade")
    off = x.where("i != j").join(F.broadcast(gone), "decade", "left_anti")
    return x.where("i = j").select("i", "j", "v").union(off.select("i", "j", "v"))
