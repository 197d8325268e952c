"""The registered queries: how Spark runs each, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.views import VIEWS, ctes, needed, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

def add(name: str, views: str, run, oracle: str | None = None, needs: str | None = None) -> None:
    """Register run(view, view, ...) over the named views, and oracle SQL over the same (or ``needs``) as CTEs."""
    names = views.split()
    _QUERIES[name] = lambda spark, sf_dir: run(*[view(spark, sf_dir, n) for n in names])
    if oracle:
        wanted = needed([n for n in (needs or views).split() if n in VIEWS])
        _ORACLES[name] = (ctes(*wanted) + "\n" + oracle.strip()) if wanted and not oracle.strip().startswith(",") else (ctes(*wanted) + oracle.strip() if wanted else oracle.strip())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
