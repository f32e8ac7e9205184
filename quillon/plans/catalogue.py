"""Registered queries over the driver's tables and their SQL, assembled from the modules beside this one."""

from __future__ import annotations

from . import queries_columns, queries_counting, queries_joins, queries_models, queries_scalars, queries_sources, queries_taxonomy

_MODULES = (queries_counting, queries_scalars, queries_joins, queries_models, queries_columns, queries_taxonomy, queries_sources)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
