"""Registered queries: each applies an operator to the driver's tables; SQL beside it gives the same rows."""

from __future__ import annotations

from . import arrays, catalog, files, metadata, points, profiles, selections, table

MODULES = [table, profiles, arrays, points, selections, catalog, metadata, files]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
