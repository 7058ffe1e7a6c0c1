"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the SQL that DuckDB runs for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def statement(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a Spark SQL statement; without another oracle DuckDB runs the same text."""
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text)
    ORACLE_SQL[name] = text if oracle is None else oracle


def load() -> None:
    """Imports the modules that register queries."""
    from . import functions, operators, plans, sources, streaming  # noqa: F401


load()
