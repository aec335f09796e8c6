"""Registered queries over the driver's tables."""

from threadloom.plans import exports, insights, queries, relations, reports, retrieval, structure  # noqa: F401
from threadloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
