"""Graphs of more than one component, orders that are undone, interpolation by definition."""

import numpy as np
import pytest

from scatterspark.functions import harmonics, polynomials
from scatterspark.operators import graphs, interpolation, orders


def test_landmarks_reach_every_component(spark):
    e = spark.createDataFrame([(a, b, 1.0) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2), (7, 8), (8, 7))], "src long, dst long, w double")
    assert graphs.landmarks(e, 3, 1) == [1, 7, 3]
    got = {r.node: r.x for r in graphs.landmark_isomap(e, 3, 2, 1).collect()}
    assert set(got) == {1, 2, 3, 7, 8} and {len(x) for x in got.values()} == {2}


@pytest.mark.parametrize("make", [lambda: interpolation.TensorInterpolator(2, 3), lambda: interpolation.monomial_interpolator(2, 3), lambda: interpolation.total_degree_interpolator(2, 3)])
def test_interpolators_reproduce_polynomials(make):
    i = make()
    x = np.random.default_rng(0).random((50, 2))
    f = lambda p: 1 + p[:, 0] - 2 * p[:, 1] ** 2 + 3 * p[:, 0] * p[:, 1] ** 2
    assert i.basis(x) @ f(i.points) == pytest.approx(f(x))
    assert i.basis(i.points) == pytest.approx(np.eye(len(i.points)), abs=1e-9)


def test_harmonics_are_orthonormal():
    z, w = np.polynomial.legendre.leggauss(12)
    phi = np.arange(24) * np.pi / 12
    s = np.sqrt(1 - z**2)
    p = np.array([[a * np.cos(t), a * np.sin(t), b] for a, b in zip(s, z) for t in phi])
    y = harmonics.spherical_harmonics(p, 5)
    assert (y * np.repeat(w * np.pi / 12, 24)[:, None]).T @ y == pytest.approx(np.eye(36), abs=1e-10)


def test_legendre_is_orthonormal_and_lagrange_exact_at_nodes():
    x, w = polynomials.gauss_legendre(10)
    p = polynomials.legendre(x, 6)
    assert (p * w[:, None]).T @ p == pytest.approx(np.eye(7), abs=1e-12)
    nodes = polynomials.chebyshev_nodes(5)
    assert polynomials.lagrange(nodes, nodes) == pytest.approx(np.eye(5))


def test_orders_of_leaves_of_different_depth(spark):
    rows = [(5, 2, 1), (1, 6, 2), (9, 6, 2), (4, 7, 2)]
    members = spark.createDataFrame(rows, "id long, path long, level int")
    assert {r.id: r.pos for r in orders.cluster_order(members).collect()} == {5: 0, 1: 1, 9: 2, 4: 3}


def test_scaling_of_points_without_their_distances(spark):
    p = np.random.default_rng(2).random((150, 3))
    df = spark.createDataFrame([(7 * i, x.tolist()) for i, x in enumerate(p)], "id long, p array<double>").repartition(3)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    ids, y, lost = graphs.mds_of_points(df, 3)
    want, none = graphs.mds(d, 3)
    assert ids == [7 * i for i in range(150)] and abs(lost) < 1e-10 and abs(none) < 1e-10
    assert y == pytest.approx(want, abs=1e-9)


def test_landmarks_by_held_distances(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (90, 2)).tolist() if a != b}
    half = [(10 * a, 10 * b, float(rng.integers(0, 5)) / 4) for a, b in sorted(pairs)] + [(1001, 1002, 1.0)]  # ties, zeros, components
    e = spark.createDataFrame(half + [(b, a, w) for a, b, w in half], "src long, dst long, w double")
    n, first = graphs.counts(e).first()["nodes"], half[0][0]
    jobs = []

    def rounds(edges, sources, *rest, real=graphs.distances):
        jobs.append(sources)
        return real(edges, sources, *rest)

    monkeypatch.setattr(graphs, "distances", rounds)
    held = graphs.landmark_distances(e, 4, first)
    got = {r.node: r.x for r in graphs.landmark_isomap(e, 4, 2, first, held).collect()}
    assert graphs.landmarks(e, 4, first) == held[0] and not jobs  # a shuffle or more for each round before
    monkeypatch.setattr(graphs, "HELD", 0)
    want = {r.node: r.x for r in graphs.landmark_isomap(e, 4, 2, first).collect()}
    assert graphs.landmarks(e, 4, first) == held[0] and jobs and len(got) == n
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for s, row in zip(held[0], held[2]):
        known = {r.node: r.dist for r in graphs.distances(e, [s]).collect()}
        assert {int(k): d for k, d in zip(held[1], row) if np.isfinite(d)} == known


def test_distortion_in_tasks(spark):
    x, y = np.random.default_rng(1).random((2, 130, 3))
    d = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    assert graphs.distortion(spark, x, y, 50) == pytest.approx(np.abs(d(x) - d(y)).max())
    ids, z, lost = graphs.mds_of_points(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, p array<double>"), 5)
    assert z.shape == (5, 130) and graphs.distortion(spark, x, z.T, 50) < 1e-12 and abs(lost) < 1e-12
