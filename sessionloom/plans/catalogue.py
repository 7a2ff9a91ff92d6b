"""All queries of the session analytics engine by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("analytics", "graphs", "recommend", "ranking", "evaluation", "serving", "interactions", "streams", "roundtrips")


def _modules():
    import importlib
    import importlib.util

    for name in _MODULES:
        full = f"sessionloom.plans.{name}"
        if importlib.util.find_spec(full):
            yield importlib.import_module(full)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _modules():
        found |= module.ORACLES
    return found
