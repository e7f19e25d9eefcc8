"""Local inverses of points that coincide."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import sparse

K = CovarianceKernel("exponential", 0.5)
PLACES = [[0.0, 0.0], [0.01, 0.0], [0.0, 0.02], [0.5, 0.5]]


def _points(spark, copies):
    rows = [(4 * c + k, p) for k, p in enumerate(PLACES) for c in range(copies[k])]
    return rows, spark.createDataFrame(rows, "id long, p array<double>")


@pytest.mark.parametrize("root", [False, True])
def test_by_dense_matrices(spark, root):
    rows, x = _points(spark, (1, 3, 5, 2))
    ids, p = [r[0] for r in rows], np.array([r[1] for r in rows])
    got = {(i, j): v for i, j, v in sparse.local_inverse(x, K, 0.1, 2, 0.1, root).collect()}
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) < 0.1
    assert set(got) == {(ids[i], ids[j]) for i, j in zip(*np.nonzero(near))}
    for i in range(len(ids)):
        n = np.flatnonzero(near[i])
        value, u = np.linalg.eigh(K.matrix(p[n], p[n]) + 0.1 * np.eye(len(n)))
        want = (u * (value**-0.5 if root else 1 / value)) @ u.T @ (n == i)
        assert [got[ids[i], ids[j]] for j in n] == pytest.approx(list(want), abs=1e-10)


def test_large_groups_of_copies_are_solved_as_one(spark):
    v, at = sparse.local_inverse_of_places(_points(spark, (3000, 1, 3000, 2))[1], K, 0.1, 2, 0.1)
    assert at.count() == 6003 and v.count() == 10
    k = {r.place: r.n for r in at.groupBy("place").agg(F.count("*").alias("n")).collect()}
    assert all(k[r.b] == r.m for r in v.collect())


def test_copies_without_a_ridge_have_no_inverse(spark):
    with pytest.raises(Exception, match="Singular"):
        sparse.local_inverse(_points(spark, (1, 2, 1, 1))[1], K, 0.1, 2).collect()
