"""All named queries with their SQL oracles."""

from __future__ import annotations

from kelpline.plans import answer_queries, files_queries, label_queries, overview_queries, record_queries, scan_queries, text_queries

_MODULES = (files_queries, text_queries, answer_queries, record_queries, overview_queries, scan_queries, label_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
