"""Registered queries of the evidence engine, gathered from the query modules."""

from __future__ import annotations

from corvane.plans import entity_queries, join_queries, record_queries, text_queries, window_queries, workflow_queries

MODULES = [text_queries, entity_queries, join_queries, window_queries, workflow_queries, record_queries]


def queries() -> dict:
    return {name: plan for m in MODULES for name, plan in m.catalog.queries.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.catalog.sql.items()}
