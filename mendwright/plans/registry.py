"""All named queries of the engine with their SQL equivalents."""

from __future__ import annotations

from mendwright.plans import matching, quality, records, spending  # noqa: F401
from mendwright.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
