"""Registration of queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scatterspark.sources.points import SQL

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, query, sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def r6(c: Column) -> Column:
    """Rounded for comparison; + 0.0 turns -0.0 into 0.0."""
    return F.round(c, 6) + F.lit(0.0)


def with_points(name: str, body: str, *more: str) -> str:
    """SQL with the point set ``name`` as ``p``."""
    return "with " + ", ".join([f"p as ({SQL[name]})", *more]) + "\n" + body


def sq(a: str, b: str, d: int) -> str:
    """Squared distance of two list columns of length d."""
    return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, d + 1)) + ")"


def sql_r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0::double)"
