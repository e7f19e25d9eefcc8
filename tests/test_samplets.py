"""The samplet transform against its definition, and with leaves larger than a task's share."""

import numpy as np
import pytest

from scatterspark.operators import samplets


def members(spark, n, level, d):
    rng = np.random.default_rng(n)
    p = rng.integers(0, 9, (n, d)) / 8.0  # many points coincide
    path = (1 << level) + np.arange(n) * (1 << level) // n
    return p, spark.createDataFrame([(i, p[i].tolist(), int(path[i]), level) for i in range(n)], "id long, p array<double>, path long, level int").repartition(3)


@pytest.mark.parametrize("level,subtree,q", [(0, 1000, 1), (1, 1000, 1), (2, 60, 1), (1, 20, 0), (1, 20, 1), (0, 30, 1)])
def test_orthonormal_with_vanishing_moments(spark, level, subtree, q):
    p, m = members(spark, 200, level, 2)
    t = samplets.basis(m, 2, q, subtree).toPandas()
    coef = {c: i for i, c in enumerate(sorted(set(zip(t["node"], t["k"], t["kind"]))))}
    a = np.zeros((len(coef), len(p)))
    for r in t.itertuples():
        a[coef[r.node, r.k, r.kind], r.id] += r.v
    assert not t.duplicated(["node", "k", "kind", "id"]).any()
    assert a @ a.T == pytest.approx(np.eye(len(p)), abs=1e-11)
    s = a[[i for c, i in coef.items() if c[2] == "s"]]
    assert np.abs(s @ np.hstack([np.ones((len(p), 1)), p][: 1 + q])).max() < 1e-11
    assert {c[0] for c in coef} <= set(range(1, 2 << level))
    n = 1 if q == 0 else 3
    for leaf in range(1 << level, 2 << level):  # a leaf has a samplet for each point but as many as there are moments
        assert sum(c[0] == leaf and c[2] == "s" for c in coef) == 200 // (1 << level) - n
        inside = set(np.flatnonzero((1 << level) + np.arange(200) * (1 << level) // 200 == leaf))
        assert set(t[(t["node"] == leaf) & (t["kind"] == "s")]["id"]) <= inside


def test_entries_of_a_large_leaf_are_few(spark):
    _, m = members(spark, 3000, 0, 2)
    assert samplets.basis(m, 2, 0).count() < 3000 * 25  # 9 million before


def test_orthonormality_is_tested_without_a_dense_matrix(spark, monkeypatch):
    import pyspark.sql.classic.dataframe as classic

    from scatterspark.plans.numeric_queries import _orthonormal, samplet_invariants

    _, m = members(spark, 200, 2, 2)
    t = samplets.basis(m, 2, 1)
    square, off = _orthonormal(t)
    assert square and off < 1e-11
    assert _orthonormal(t.selectExpr("node", "k", "kind", "id", "v * if(id = 7, 1.1, 1) as v"))[1] > 0.01
    assert not _orthonormal(t.where("kind = 's'"))[0]

    def gathered(self):
        raise AssertionError("a whole table on the driver")

    monkeypatch.setattr(classic.DataFrame, "toPandas", gathered)
    assert all(samplet_invariants(spark, "/root/testdata/sf0.001").first())


def test_compressed_kernel_holds_strips(spark):
    from scatterspark.functions.kernels import CovarianceKernel
    from scatterspark.operators import orders

    class Strips:
        def matrix(self, p, q):
            assert len(p) * len(q) <= 2000
            return CovarianceKernel("exponential", 0.5).matrix(p, q)

    p, m = members(spark, 200, 2, 2)
    kernel = CovarianceKernel("exponential", 0.5)
    got = orders.compressed_kernel(m, Strips(), 2, 1, entries=2000).toPandas()
    whole = kernel.matrix(p, p)
    twice = np.where(got["i"] == got["j"], 1, 2)
    assert (twice * got["v"] ** 2).sum() == pytest.approx((whole**2).sum())
    assert got[got["i"] == got["j"]]["v"].sum() == pytest.approx(np.trace(whole))
    assert not got.duplicated(["i", "j"]).any()


@pytest.mark.parametrize("level,subtree,q", [(0, 1000, 0), (3, 1000, 1), (2, 60, 1), (1, 20, 0)])
def test_matrix_there_and_back_by_pairs_of_leaves(spark, level, subtree, q):
    from scatterspark.operators import orders

    p, m = members(spark, 200, level, 2)
    t = samplets.basis(m, 2, q, subtree, near=True)
    rows = t.join(orders.coefficient_numbers(t), ["node", "k", "kind"]).toPandas()
    dense = np.zeros((200, 200))
    dense[rows["i"], rows["id"]] = rows["v"]
    assert dense @ dense.T == pytest.approx(np.eye(200), abs=1e-11)
    a = np.zeros((200, 200))
    i = np.arange(198)
    a[i, i], a[i, i + 2] = 2.0, 0.1 + i / 100  # not symmetric; most pairs of leaves have no entry
    x, y = np.nonzero(a)
    half = spark.createDataFrame([(int(r), int(c), float(a[r, c]) / 2) for r, c in zip(x, y)], "i long, j long, v double")
    b = orders.transform_matrix(t, half.union(half), m)
    got = b.toPandas()
    assert not got.duplicated(["i", "j"]).any()
    there = np.zeros((200, 200))
    there[got["i"], got["j"]] = got["v"]
    assert there == pytest.approx(dense @ a @ dense.T, abs=1e-11)
    back = orders.inverse_transform_matrix(t, b, m).toPandas()
    home = np.zeros((200, 200))
    home[back["i"], back["j"]] = back["v"]
    assert home == pytest.approx(a, abs=1e-11)
    met = {(r * (1 << level) // 200, c * (1 << level) // 200) for r, c in zip(x, y)}
    assert {(r * (1 << level) // 200, c * (1 << level) // 200) for r, c in zip(back["i"], back["j"])} <= met  # all pairs before


def test_pieces_of_a_leaf_by_place(spark):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 40, (400, 2)) / 40.0
    m = spark.createDataFrame([(i, p[i].tolist(), 1, 0) for i in range(400)], "id long, p array<double>, path long, level int")
    spread = {}
    for near in (False, True):
        t = samplets.basis(m, 2, 0, near=near).where("kind = 's'").toPandas()
        spread[near] = np.mean([np.ptp(p[g["id"]], axis=0).max() for _, g in t.groupby("k")])
    assert spread[True] < spread[False] / 2


@pytest.mark.parametrize("level,cell,threshold", [(2, 1024, 0.0), (2, 15, 0.0), (0, 30, 0.0), (0, 1000, 0.0), (3, 10, 0.03)])
def test_compressed_kernel_by_cells(spark, level, cell, threshold):
    from scatterspark.functions.kernels import CovarianceKernel
    from scatterspark.operators import orders

    p, m = members(spark, 200, level, 2)
    kernel, met = CovarianceKernel("exponential", 0.5), spark.sparkContext.accumulator(0)

    class Counted:
        def matrix(self, a, b):
            met.add(len(a) * len(b))
            return kernel.matrix(a, b)

    t = samplets.basis(m, 2, 1)
    rows = t.join(orders.coefficient_numbers(t), ["node", "k", "kind"]).toPandas()
    dense = np.zeros((200, 200))
    dense[rows["i"], rows["id"]] = rows["v"]
    want = dense @ kernel.matrix(p, p) @ dense.T
    got = orders.compressed_kernel(m, Counted(), 2, 1, threshold, cell=cell).toPandas()
    assert (got["i"] <= got["j"]).all() and not got.duplicated(["i", "j"]).any()
    there = np.zeros((200, 200))
    there[got["i"], got["j"]] = got["v"]
    keep = np.triu((np.abs(want) > threshold) | np.eye(200, dtype=bool))
    assert there == pytest.approx(np.where(keep, want, 0), abs=1e-11)
    assert met.value <= 2.5 * 200 * 200  # twice for each pair of points; every pair of levels before


def test_sums_of_coefficient_points_are_taken_by_cluster(spark):
    from pyspark.sql import functions as F

    from scatterspark.operators import orders

    _, m = members(spark, 200, 2, 2)
    numbers = orders.coefficient_numbers(samplets.basis(m, 2, 0))
    n, ids = F.count("*").alias("n"), F.sum("id").alias("ids")
    want = orders.coefficient_points(numbers, m).groupBy("i").agg(n, ids)
    got = orders.coefficient_points(numbers, m, n, ids)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 200
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("count(1)")  # summed below the join: 200 clusters' points a row before


@pytest.mark.parametrize("level,subtree,q", [(0, 1000, 0), (3, 1000, 1), (2, 60, 1)])
def test_matrix_by_places(spark, level, subtree, q):
    from scatterspark.operators import orders

    p, m = members(spark, 400, level, 2)
    p[:150] = p[0]  # a place of many points
    m = spark.createDataFrame([(r.id, p[r.id].tolist(), r.path, r.level) for r in m.collect()], m.schema)
    t = samplets.basis(m, 2, q, subtree, near=True)
    own, of = orders.places(m)
    coarse, fine = orders.transform_by_places(t, of, own)
    place = of.toPandas().set_index("id")["place"]
    for _, g in t.where("kind = 's'").toPandas().groupby(["node", "k"]):  # pieces of a leaf went across places before
        on = g.groupby(place[g["id"]].to_numpy())["v"]
        inside = g["node"].iloc[0] >= 1 << level and level == 0 or subtree == 1000
        assert not inside or (len(on) == 1 and abs(on.sum().iloc[0]) < 1e-12) or on.agg(np.ptp).max() < 1e-12
    if subtree != 1000:
        return
    sizes = own.toPandas().set_index("id")
    z, n = np.array(sizes["p"].tolist()), len(sizes)
    value = np.exp(-np.abs(z[:, None] - z[None]).sum(-1))
    value[value < 0.6] = 0
    scale = np.sqrt(np.outer(sizes["m"], sizes["m"]))
    x, y = np.nonzero(value + np.eye(n))
    ids = sizes.index.to_numpy()
    a = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(value[i, j] * scale[i, j] + 1.5 * (i == j))) for i, j in zip(x, y)], "i long, j long, v double")
    b = orders.transform_matrix(coarse, a, own).toPandas()
    numbers = orders.fine_numbers(fine, 1.5)
    assert numbers.count() + n == 400
    at = np.searchsorted(ids, place.sort_index())
    whole = value[at][:, at] + 1.5 * np.eye(400)
    diagonal = numbers.toPandas()["v"]
    assert (b["v"] ** 2).sum() + (diagonal**2).sum() == pytest.approx((whole**2).sum())
    assert b[b["i"] == b["j"]]["v"].sum() + diagonal.sum() == pytest.approx(np.trace(whole))
    rest = a.where("i = j").join(own.withColumnRenamed("id", "i"), "i").selectExpr("i as place", "m", "v", "1.0D as w")
    assert orders.errors_on_places(fine, numbers, rest, 1.5, 500).toPandas()["off"].max() < 1e-11
    wrong = numbers.selectExpr("place", "c", "v * 1.01 as v")
    assert orders.errors_on_places(fine, wrong, rest, 1.5, 500).toPandas()["off"].max() > 1e-3


def test_matrix_query_spells_out_no_pairs_of_points(spark, monkeypatch):
    from scatterspark.operators import neighbours
    from scatterspark.plans.catalog import QUERIES

    def spelled(*args):
        raise AssertionError("all pairs of points")

    monkeypatch.setattr(neighbours, "sym_eps_nn", spelled)
    row = QUERIES["samplet_transform_of_matrix"](spark, "/root/testdata/sf0.001").first()
    assert row["trace"] == 400.0 and row["off"] == 0.0
