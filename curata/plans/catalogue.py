"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The query that ``entry`` runs.
FLAGSHIP = "ngram_contamination"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function, with the SQL that gives the same rows where there is one."""

    def put(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    from curata import plans

    for m in sorted(x.name for x in pkgutil.iter_modules(plans.__path__) if x.name.startswith("q_")):
        importlib.import_module(f"curata.plans.{m}")
