"""Queries over the driver's tables, with the SQL that gives the same rows.

Each query applies an operator of the library to a whole table whose columns stand in for the domain's.
"""

from __future__ import annotations

from . import queries_fields, queries_geo, queries_grid, queries_more, queries_points, queries_series
from .registry import ORACLE_SQL, QUERIES, query, table

__all__ = ["ORACLE_SQL", "QUERIES", "query", "table", "queries_fields", "queries_geo", "queries_grid", "queries_more", "queries_points", "queries_series"]
