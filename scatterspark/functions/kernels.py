"""Covariance kernels as Catalyst expressions of a distance column.

``CovarianceKernel(name, l, c, nu)`` is a value object; calling it with two ``array<double>`` columns gives the kernel
column. Names are case-insensitive, unknown ones raise ``ValueError``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scatterspark.functions.distances import distance, euclidean

EPS = 2.220446049250313e-16


def _poly(s: Column, coefficients: list[float]) -> Column:
    """Horner evaluation, coefficients from the constant upwards."""
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * s + F.lit(c)
    return out


def matern_coefficients(p: int) -> list[float]:
    """Polynomial of the Matern kernel with nu = p + 1/2 in s = sqrt(2 nu) r / l."""
    f = math.factorial
    return [f(p) / f(2 * p) * f(2 * p - k) / (f(k) * f(p - k)) * 2.0**k for k in range(p + 1)]


def _matern(p: int):
    def fn(r: Column, l: float, c: float, nu: float) -> Column:  # noqa: E741
        s = r * F.lit(math.sqrt(2 * p + 1) / l)
        return _poly(s, matern_coefficients(p)) * F.exp(-s)

    return fn


def bessel_k(nu: float, x: np.ndarray, nodes: int = 400) -> np.ndarray:
    """Modified Bessel function of the second kind, by the trapezoidal rule on exp(-x cosh t) cosh(nu t)."""
    top = np.arccosh(1 + 800 / np.maximum(x, 1e-300))
    top = np.minimum(top, (700 + abs(nu)) / max(1.0, abs(nu)) if nu > 1 else 700)
    t = np.linspace(0, 1, nodes + 1)[None, :] * top[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        y = np.exp(-x[:, None] * np.cosh(t) + np.log(np.cosh(np.minimum(nu * t, 700))))
    y[:, [0, -1]] /= 2
    return y.sum(1) * top / nodes


def _matern_nu(r: Column, l: float, c: float, nu: float) -> Column:  # noqa: E741
    if abs(nu - 0.5 - round(nu - 0.5)) < 1e-12 and nu > 0:
        return _matern(round(nu - 0.5))(r, l, c, nu)

    @pandas_udf("double")
    def general(d: pd.Series) -> pd.Series:
        s = math.sqrt(2 * nu) * d.to_numpy(dtype=float) / l
        out = np.ones(len(s))
        far = s > 1e-12
        out[far] = 2 ** (1 - nu) / math.gamma(nu) * s[far] ** nu * bessel_k(nu, s[far])
        return pd.Series(out)

    return general(r)


KERNELS = {
    "BIHARMONIC2D": lambda r, l, c, nu: F.when(r < EPS, F.lit(0.0)).otherwise((r / l) * (r / l) * F.log(r / l)),
    "BIHARMONIC3D": lambda r, l, c, nu: r / l,
    "TRIHARMONIC3D": lambda r, l, c, nu: (r / l) * (r / l) * (r / l),
    "EXPONENTIAL": lambda r, l, c, nu: F.exp(-r / l),
    "MATERN32": _matern(1),
    "MATERN52": _matern(2),
    "MATERN72": _matern(3),
    "MATERN92": _matern(4),
    "GAUSSIAN": lambda r, l, c, nu: F.exp(-(r * r) / (2 * l * l)),
    "MATERNNU": _matern_nu,
    "INVMULTIQUADRIC": lambda r, l, c, nu: 1 / F.sqrt((r / l) * (r / l) + c * c),
    "MULTIQUADRIC": lambda r, l, c, nu: F.sqrt((r / l) * (r / l) + c * c),
    "TPS2D": lambda r, l, c, nu: F.when(r < EPS, F.lit(0.0)).otherwise(r * r * F.log(r)),
}


@dataclass(frozen=True)
class CovarianceKernel:
    name: str
    l: float = 1.0  # noqa: E741
    c: float = 1.0
    nu: float = 1.0
    metric: str = "EUCLIDEAN"

    def __post_init__(self):
        if self.name.upper() not in KERNELS:
            raise ValueError(f"unknown kernel {self.name!r}; known: {sorted(KERNELS)}")
        distance(self.metric)

    def of(self, r: Column) -> Column:
        return KERNELS[self.name.upper()](r, float(self.l), float(self.c), float(self.nu))

    def __call__(self, a: Column, b: Column) -> Column:
        return self.of(distance(self.metric)(a, b))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dense block for rows of ``a`` and ``b``, for use inside grouped functions."""
        if self.metric.upper() == "GEODESIC":
            r = np.arccos(np.clip(a @ b.T, -1, 1))
        else:
            few = a.shape[1] < 8  # summed in the same order, without a block for each coordinate
            r = np.sqrt(sum((x[:, None] - y) ** 2 for x, y in zip(a.T, b.T)) if few else ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1))
        return self.values(r)

    def values(self, r: np.ndarray) -> np.ndarray:
        l, c, name = self.l, self.c, self.name.upper()  # noqa: E741
        with np.errstate(divide="ignore", invalid="ignore"):
            if name == "BIHARMONIC2D":
                return np.where(r < EPS, 0.0, (r / l) ** 2 * np.log(r / l))
            if name == "BIHARMONIC3D":
                return r / l
            if name == "TRIHARMONIC3D":
                return (r / l) ** 3
            if name == "EXPONENTIAL":
                return np.exp(-r / l)
            if name == "GAUSSIAN":
                return np.exp(-(r**2) / (2 * l * l))
            if name == "INVMULTIQUADRIC":
                return 1 / np.sqrt((r / l) ** 2 + c * c)
            if name == "MULTIQUADRIC":
                return np.sqrt((r / l) ** 2 + c * c)
            if name == "TPS2D":
                return np.where(r < EPS, 0.0, r * r * np.log(r))
            p = {"MATERN32": 1, "MATERN52": 2, "MATERN72": 3, "MATERN92": 4}.get(name, self.nu - 0.5)
            if p == round(p):
                s = math.sqrt(2 * p + 1) * r / l
                return np.polyval(matern_coefficients(round(p))[::-1], s) * np.exp(-s)
            s = math.sqrt(2 * self.nu) * r / l
            out = np.ones_like(s)
            far = s > 1e-12
            out[far] = 2 ** (1 - self.nu) / math.gamma(self.nu) * s[far] ** self.nu * bessel_k(self.nu, s[far])
            return out


def space_time_periodic(a: Column, b: Column, l: float = 1.0, c: float = 1.0) -> Column:  # noqa: E741
    """Matern-3/2 in the first two coordinates times a periodic kernel in the third."""
    head = lambda p: F.slice(p, 1, 2)
    dt = F.element_at(a, 3) - F.element_at(b, 3)
    s = F.sin(F.lit(math.pi) * dt)
    return CovarianceKernel("MATERN32", l).of(euclidean(head(a), head(b))) * F.exp(-2 * s * s / (c * c))
