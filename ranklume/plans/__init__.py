"""Registered queries: each has a name, a plan over a Catalog, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..binding import Catalog, with_views

PLANS: dict[str, Callable[[Catalog], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None, name: str | None = None):
    """Registers a plan; sql may read driver tables and views."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        key = name or f.__name__
        PLANS[key] = f
        if sql:
            SQL[key] = with_views(sql)
        return f

    return add


def _loaded() -> None:
    from . import aggregates, browsing, curation, entities, extensions, importing, predicates, rankings, reviewing, searching, sinking, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _loaded()
    return {name: (lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir))) for name, f in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _loaded()
    return dict(SQL)
