"""All registered queries with their SQL counterparts."""

from __future__ import annotations

from scatterspark.plans import interpolation_queries, kernel_queries, neighbour_queries, numeric_queries, order_queries, tree_queries, utility_queries  # noqa: F401
from scatterspark.plans.base import ORACLES, QUERIES  # noqa: F401
