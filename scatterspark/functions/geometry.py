"""Predicates and distances of cluster boxes, and admissibility rules, as Column expressions.

A cluster is described by ``lo`` and ``hi`` (``array<double>``); its radius is half the box diagonal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scatterspark.functions.distances import dot, euclidean

LOW_RANK, DENSE, REFINE = "low_rank", "dense", "refine"


def in_box(p: Column, lo: Column, hi: Column) -> Column:
    """Whether p lies in the closed box."""
    return F.forall(F.arrays_zip(p.alias("p"), lo.alias("l"), hi.alias("h")), lambda z: (z["p"] >= z["l"]) & (z["p"] <= z["h"]))


def mid(lo: Column, hi: Column) -> Column:
    return F.zip_with(lo, hi, lambda a, b: (a + b) / 2)


def radius(lo: Column, hi: Column) -> Column:
    return euclidean(lo, hi) / 2


def point_ball_distance(p: Column, lo: Column, hi: Column) -> Column:
    """Distance from p to the ball around the box."""
    return F.greatest(F.lit(0.0), euclidean(p, mid(lo, hi)) - radius(lo, hi))


def ball_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.greatest(F.lit(0.0), euclidean(mid(lo1, hi1), mid(lo2, hi2)) - radius(lo1, hi1) - radius(lo2, hi2))


def box_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    gap = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0.0), x - y) * F.greatest(F.lit(0.0), x - y))
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total(gap(lo1, hi2)) + total(gap(lo2, hi1)))


def admissible(r1: Column, r2: Column, dist: Column, leaf1: Column, leaf2: Column, eta: float) -> Column:
    """Low rank if max(r) <= eta * distance, else dense if either is a leaf, else refine."""
    return F.when(F.greatest(r1, r2) <= eta * dist, LOW_RANK).when(leaf1 | leaf2, DENSE).otherwise(REFINE)


def compare_cluster(a: str, b: str, eta: float, distance=ball_distance) -> Column:
    """Admissibility of two node rows whose columns carry the suffixes a and b (lo, hi, leaf)."""
    c = lambda n, s: F.col(f"{n}{s}")
    lo1, hi1, lo2, hi2 = c("lo", a), c("hi", a), c("lo", b), c("hi", b)
    return admissible(radius(lo1, hi1), radius(lo2, hi2), distance(lo1, hi1, lo2, hi2), c("leaf", a), c("leaf", b), eta)


def compare_cluster_strict(a: str, b: str) -> Column:
    """Low rank unless one box contains the other."""
    c = lambda n, s: F.col(f"{n}{s}")
    inside = lambda x, y: in_box(c("lo", x), c("lo", y), c("hi", y)) & in_box(c("hi", x), c("lo", y), c("hi", y))
    return F.when(~(inside(a, b) | inside(b, a)), LOW_RANK).when(c("leaf", a) | c("leaf", b), DENSE).otherwise(REFINE)


def spherical_distance(c1: Column, r1: Column, c2: Column, r2: Column) -> Column:
    """Great-circle distance of two caps."""
    return F.greatest(F.lit(0.0), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(c1, c2)))) - r1 - r2)


def time_periodic_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Box centres' distance with the last coordinate periodic on [0, 1), measured by sin(pi t) / pi, less the radii."""
    d = F.zip_with(mid(lo1, hi1), mid(lo2, hi2), lambda x, y: x - y)
    head = F.aggregate(F.slice(d, F.lit(1), F.size(d) - 1), F.lit(0.0), lambda s, x: s + x * x)
    t = F.sin(F.element_at(d, -1) * math.pi) / math.pi
    return F.greatest(F.lit(0.0), F.sqrt(head + t * t) - radius(lo1, hi1) - radius(lo2, hi2))
