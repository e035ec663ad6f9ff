"""The queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def tidy(x: str) -> str:
    """SQL for a number rounded to 12 significant digits."""
    return f"CAST(printf('%.11e', {x}) AS DOUBLE)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
