"""One-dimensional nodes and polynomials on [0, 1]; all are computed from their definitions."""

from __future__ import annotations

import functools

import numpy as np


def gauss_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the rule on [0, 1] that is exact up to degree 2 n - 1."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


@functools.lru_cache
def leja_points(n: int) -> np.ndarray:
    """1, 0, then always the (leftmost) point that maximises the product of the distances to those before it.

    Between two neighbours the logarithm of the product is concave, so a ternary search finds each maximum.
    """
    out = [1.0, 0.0][:n]
    while len(out) < n:
        x = np.sort(out)
        a, b = x[:-1].copy(), x[1:].copy()
        value = lambda t: np.log(np.abs(t[:, None] - x)).sum(1)
        for _ in range(120):
            l, r = a + (b - a) / 3, b - (b - a) / 3  # noqa: E741
            left = value(l) >= value(r)
            a, b = np.where(left, a, l), np.where(left, r, b)
        m = (a + b) / 2
        v = value(m)
        out.append(float(m[np.flatnonzero(v >= v.max() - 1e-9)[0]]))
    return np.array(out)


def chebyshev_nodes(n: int) -> np.ndarray:
    """The n zeros of the Chebyshev polynomial of degree n, ascending."""
    return (1 - np.cos((2 * np.arange(n) + 1) * np.pi / (2 * n))) / 2


def legendre(x: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal Legendre polynomials of degrees 0 to ``degree`` by column."""
    t = 2 * np.asarray(x, float) - 1
    p = [np.ones_like(t), t]
    for k in range(1, degree):
        p.append(((2 * k + 1) * t * p[k] - k * p[k - 1]) / (k + 1))
    return np.stack([np.sqrt(2 * k + 1) * p[k] for k in range(degree + 1)], axis=-1)


def monomials(x: np.ndarray, degree: int) -> np.ndarray:
    return np.asarray(x, float)[..., None] ** np.arange(degree + 1)


def lagrange(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Lagrange polynomials of ``nodes`` at x by column, in barycentric form."""
    x, n = np.asarray(x, float), len(nodes)
    apart = nodes[:, None] - nodes + np.eye(n)
    weight = 1 / apart.prod(1)
    d = x[..., None] - nodes
    at = d == 0
    q = weight / np.where(at, 1, d)
    out = q / q.sum(-1, keepdims=True)
    return np.where(at.any(-1, keepdims=True), at.astype(float), out)
