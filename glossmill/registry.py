"""All queries of the core, by name, with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "rank_queries", "store_queries", "answer_queries", "more_queries", "evidence_queries")


def _modules():
    return [import_module(f"glossmill.plans.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _modules() for name, text in module.SQL.items()}
