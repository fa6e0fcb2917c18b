"""Registers queries over the tables of a folder, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from ..tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The time that queries take as now: the end of the events.
AS_OF_TEXT = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


def query(sql: str | None = None):
    """Registers fn(tables) under its name."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import applied, catalog, derived, ingest, landed, reports, rules, state, streams, text, trust  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
