"""All queries over the given tables."""

from __future__ import annotations

from weftbase.plans import job_queries, store_queries, text_queries  # noqa: F401
from weftbase.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
