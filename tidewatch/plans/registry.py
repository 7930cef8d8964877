"""A query and its SQL twin, registered together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` as ``name``; ``sql`` (a SELECT, or more table expressions and a SELECT) sees the same views."""

    def add(f: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {SQL_VIEWS.strip()}{'' if body.upper().startswith('SELECT') else ','}\n{body}"
        return f

    return add
