"""All queries of the library and the SQL that states their results."""

from __future__ import annotations

import importlib

from .plans.registry import Query

#: Modules with a Registry named R.
TOPICS = ["interval_queries", "search_queries", "profile_queries", "sequence_queries", "work_queries", "more_queries", "evidence_queries", "plan_queries"]


def _registries() -> list:
    return [importlib.import_module(f"cutledger.plans.{t}").R for t in TOPICS]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
