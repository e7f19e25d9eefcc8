"""Real spherical harmonics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def spherical_harmonics(p: np.ndarray, degree: int) -> np.ndarray:
    """Orthonormal real harmonics at the unit vectors ``p``, columns (l, m) with l = 0..degree and m = -l..l.

    r^m cos(m phi) and r^m sin(m phi) are polynomials in x and y; what is left of the associated Legendre functions is a
    polynomial in z, by the usual recurrence in l (without the sign (-1)^m).
    """
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    out = np.empty((len(p), (degree + 1) ** 2))
    c, s = np.ones(len(p)), np.zeros(len(p))
    for m in range(degree + 1):
        top = math.prod(range(1, 2 * m, 2))  # (2 m - 1)!!
        before, now = np.zeros(len(p)), np.full(len(p), float(top))
        for l in range(m, degree + 1):  # noqa: E741
            k = math.sqrt((2 * l + 1) / (4 * math.pi) * math.factorial(l - m) / math.factorial(l + m)) * (math.sqrt(2) if m else 1)
            out[:, l * l + l + m] = k * now * c
            if m:
                out[:, l * l + l - m] = k * now * s
            before, now = now, ((2 * l + 1) * z * now - (l + m) * before) / (l - m + 1)
        c, s = c * x - s * y, c * y + s * x
    return out


def evaluate(points: DataFrame, degree: int) -> DataFrame:
    """``(id, y array<double>)``: the (degree + 1)^2 harmonics at points on the unit sphere."""

    def fn(batches):
        for b in batches:
            p = np.array(b.column(1).to_pylist(), float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(spherical_harmonics(p, degree)), pa.list_(pa.float64()))], ["id", "y"])

    return points.select("id", "p").mapInArrow(fn, "id long, y array<double>")
