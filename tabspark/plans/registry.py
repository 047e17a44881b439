"""All registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("table_queries", "explore_queries", "prepare_queries", "metric_queries", "rule_queries", "model_queries")


def _merged(attribute: str) -> dict:
    result: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"tabspark.plans.{name}"), attribute)
        repeated = result.keys() & part.keys()
        if repeated:
            raise ValueError(f"query registered twice: {sorted(repeated)}")
        result |= part
    return result


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
