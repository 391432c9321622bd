"""Registry of named queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query under a name, with DuckDB SQL for the same rows if there is any."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = (f, sql)
        return f

    return keep


def _load() -> None:
    from importlib import import_module

    for module in ("intervals", "alignment", "genome", "statistics", "relational", "ledger", "theory", "streams", "catalog", "files"):
        import_module(f"strandframe.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in _QUERIES.items() if s}
