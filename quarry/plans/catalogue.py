"""The engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from quarry.plans import library
from quarry.plans.library import flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries():
    return dict(library.QUERIES)


def oracle_sql():
    return dict(library.ORACLES)
