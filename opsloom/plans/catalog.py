"""Registry of named queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsloom.session import widen

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ints: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its DuckDB twin, if one can state it.

    ``ints`` names columns that are 32-bit in Spark and 64-bit in the twin.
    """
    if sql is not None and ints:
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints)
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table about to be scanned as text, spread over all cores if it is one file."""
    rows = table(spark, sf_dir, name)
    return widen(rows.select(*columns) if columns else rows, rows.columns[0])
