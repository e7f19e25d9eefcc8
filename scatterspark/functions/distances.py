"""Distances between ``array<double>`` columns, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_euclidean(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def geodesic(a: Column, b: Column) -> Column:
    """Great-circle distance of unit vectors; the cosine is clamped to [-1, 1]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


DISTANCES = {"EUCLIDEAN": euclidean, "GEODESIC": geodesic}


def distance(name: str):
    try:
        return DISTANCES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown distance {name!r}; known: {sorted(DISTANCES)}") from None
