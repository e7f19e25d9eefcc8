"""The range finder behind the truncated eigendecomposition, against the exact one."""

import numpy as np

from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import lowrank


def test_more_points_than_the_limit(spark):
    rng = np.random.default_rng(1)
    p = rng.random((300, 2))
    df = spark.createDataFrame([(1000 - i, [float(v) for v in x]) for i, x in enumerate(p)], "id long, p array<double>").repartition(3)
    for name, scale, tol in (("gaussian", 1.0, 1e-3), ("exponential", 0.5, 5e-2)):
        kernel = CovarianceKernel(name, scale)
        ids, exact = lowrank.truncated_eigen(df, kernel, tol)
        again, l = lowrank.truncated_eigen(df, kernel, tol, limit=100)  # noqa: E741
        k = kernel.matrix(p[::-1], p[::-1])
        assert again == ids == list(range(701, 1001))
        assert np.trace(k) - (l * l).sum() <= tol * np.trace(k) + 1e-9 and exact.shape[1] <= l.shape[1] <= exact.shape[1] + 3
        assert np.abs(l @ l.T - exact @ exact.T).max() < tol * 10


def test_training_and_prediction_share_a_factor(spark):
    p = np.random.default_rng(1).random((20000, 2))
    rows = [(i, [float(a), float(b)], float(np.sin(3 * a) + b)) for i, (a, b) in enumerate(p)]
    x = spark.createDataFrame(rows, "id long, p array<double>, y double").repartition(4)
    got = lowrank.gaussian_process(x, CovarianceKernel("gaussian", 1.0), "y", 1e-6, x.limit(2000), 30).collect()
    assert max(abs(r["mean"] - rows[r["id"]][2]) for r in got) < 1e-3
    assert min(r["variance"] for r in got) > -1e-6
