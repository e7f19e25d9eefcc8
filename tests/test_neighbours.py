"""Radius joins of points that coincide, against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from scatterspark.operators import neighbours


def test_coinciding_points(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = [tuple(float(v) for v in x) for x in rng.integers(0, 8, (300, 2)) / 8 - 0.5]
    df = spark.createDataFrame([(5 * i, list(x)) for i, x in enumerate(p)], "id long, p array<double>").repartition(3)
    seen, real = [], neighbours._range_pairs
    monkeypatch.setattr(neighbours, "_range_pairs", lambda a, b, *c: (seen.append(a.count()), real(a, b, *c))[1])
    want = {(5 * i, 5 * j): math.dist(x, y) for i, x in enumerate(p) for j, y in enumerate(p) if math.dist(x, y) < 0.2}
    got = neighbours.sym_eps_nn(df, 0.2, 2).collect()
    assert sorted((r.i, r.j, r.dist) for r in got) == sorted((i, j, d) for (i, j), d in want.items() if i != j)
    counts = {r.q: r.n for r in neighbours.eps_counts(df, 0.2, 2).collect()}
    assert counts == {5 * i: sum(q == 5 * i for q, _ in want) for i in range(300)}
    assert seen and max(seen) <= 64  # places, not points


def test_exploded_cells_are_not_broadcast(spark):
    df = spark.range(1000).select("id", F.array(F.rand(1), F.rand(2)).alias("p"))
    plan = neighbours.eps_nn(df, df, 0.1, 2)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
