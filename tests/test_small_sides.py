"""Joins that must not send the points to all tasks, whatever their size is taken for."""

import numpy as np
from pyspark.sql import functions as F

from scatterspark.functions.kernels import CovarianceKernel
from scatterspark.operators import lowrank, orders


def test_spheres_send_the_nodes(spark, tmp_path):
    rows = [(i, [float(i), 0.0], 2 + i % 2, 1) for i in range(200)]
    spark.createDataFrame(rows, "id long, p array<double>, path long, level int").write.parquet(str(tmp_path / "m"))
    s = orders.spheres(spark.read.parquet(str(tmp_path / "m")), 2)
    assert s.count() == 3
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_targets_are_not_broadcast(spark, tmp_path, monkeypatch):
    spark.range(500).select("id", F.array(F.rand(1), F.rand(2)).alias("p"), F.rand(3).alias("y")).write.parquet(str(tmp_path / "x"))
    x, plans, real = spark.read.parquet(str(tmp_path / "x")), [], lowrank.gram
    monkeypatch.setattr(lowrank, "gram", lambda rows, r: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), real(rows, r))[1])
    k = CovarianceKernel("gaussian", 1.0)
    lowrank.gaussian_process(x, k, "y", 1e-3, x, 10)
    lowrank.conditional_mean(x, "p", "y", k, np.array([[0.3, 0.4]]), 10, 1e-3)
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
