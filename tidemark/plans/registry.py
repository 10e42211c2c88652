"""Where the named queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.plans.tables import Tables
from tidemark.plans.tables_sql import with_views
from tidemark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register fn(tables) under `name`; `views` lists the views its SQL twin reads."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(views.split(), sql)
        return fn

    return register


def stamp(column: str | Column) -> Column:
    """Timestamps leave the registry as text, the same in every engine."""
    c = F.col(column) if isinstance(column, str) else column
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(column: str | Column) -> Column:
    """Six decimals for comparison, half away from zero on the double itself as DuckDB does it."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


def big(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint")
