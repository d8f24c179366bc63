"""All registered queries."""

from __future__ import annotations

from markertree.plans import queries_models, queries_stats, queries_tables  # noqa: F401
from markertree.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
