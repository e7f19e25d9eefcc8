"""Cross approximation where pivots can miss rows, and of points that coincide."""

import numpy as np
import pytest

from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import hmatrix


def both(a, tol=1e-10):
    left, right = hmatrix.aca(lambda i: a[i], lambda j: a[:, j], *a.shape, tol)
    return left @ right.T


def test_rows_that_the_first_pivots_do_not_see():
    a = np.zeros((60, 50))
    a[:30, :25], a[30:, 25:] = 1.0, 2.0
    assert both(a) == pytest.approx(a)
    assert both(np.zeros((5, 4))) == pytest.approx(np.zeros((5, 4)))


def test_lattices_with_copies():
    rng = np.random.default_rng(0)
    p = np.column_stack([rng.integers(0, 9, 400) / 50, rng.integers(0, 400, 400) / 1000])
    q = np.column_stack([rng.integers(30, 50, 500) / 50, rng.integers(500, 999, 500) / 1000])
    p[200:] = p[:200]
    a = CovarianceKernel("exponential", 1.0).matrix(p, q)
    assert np.linalg.norm(both(a) - a) <= 1e-9 * np.linalg.norm(a)


def test_dense_products_in_tiles(monkeypatch):
    k = CovarianceKernel("gaussian", 1.0)
    rng = np.random.default_rng(0)
    p, q, v = rng.random((70, 2)), rng.random((30, 2)), rng.random(30)
    want, seen, real = k.matrix(p, q) @ v, [], CovarianceKernel.matrix
    monkeypatch.setattr(CovarianceKernel, "matrix", lambda self, a, b: (seen.append(len(a) * len(b)), real(self, a, b))[1])
    assert hmatrix.product(k, p, q, v, 100) == pytest.approx(want)
    assert max(seen) <= 100


def test_points_that_coincide_are_one(spark):
    rows = [(i, [float(i % 4), 0.0], 4 + i // 20, 2) for i in range(80)]
    members = spark.createDataFrame(rows, "id long, p array<double>, path long, level int")
    x = spark.createDataFrame([(i, i / 7) for i in range(80)], "id long, x double")
    at, sums = hmatrix.places(members, x)
    assert at.count() == sums.count() == 16 and sums.groupBy().sum("x").first()[0] == pytest.approx(sum(range(80)) / 7)
    back = {r.id: r.y for r in hmatrix.everywhere(members, at, at.selectExpr("id", "p[0] + 10 * path as y")).collect()}
    assert back == {i: i % 4 + 10.0 * (4 + i // 20) for i in range(80)}
