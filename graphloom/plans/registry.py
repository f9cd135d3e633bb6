"""All queries of the library outside the llm subpackage."""

from __future__ import annotations

_MODULES = ("q_text", "q_extract", "q_graph", "q_review", "q_dataset", "q_audit", "q_sources")


def queries() -> dict:
    import importlib

    found: dict = {}
    for name in _MODULES:
        found |= importlib.import_module(f"graphloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    import importlib

    found: dict = {}
    for name in _MODULES:
        found |= importlib.import_module(f"graphloom.plans.{name}").ORACLE
    return found
