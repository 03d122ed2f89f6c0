"""Registered queries of the event library and their DuckDB counterparts."""

from __future__ import annotations

from tessella.plans import queries_events, queries_likelihood, queries_models, queries_training, queries_trees

MODULES = (queries_events, queries_models, queries_trees, queries_training, queries_likelihood)
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
