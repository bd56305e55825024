"""Registration of queries: a name, a function of the study tables, a check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..domain import Domain, cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(domain)``; ``sql`` may refer to the named derived views."""
    names = views.split() if isinstance(views, str) else views

    def register(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (cte(*names) if names else "") + sql
        return fn

    return register
