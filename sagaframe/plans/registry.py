"""Queries by name, each with the statement that DuckDB runs for comparison, where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(column):
    """Days since 1970-01-01."""
    return F.unix_date(F.col(column).cast("date")).cast("long")


def micros(column):
    return F.unix_micros(F.col(column).cast("timestamp"))


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Order spans: the order's day and as many days more as its key says, 1 to 30."""
    return table(spark, folder, "orders").select("o_orderkey", "o_custkey", day("o_orderdate").alias("a"), (day("o_orderdate") + 1 + F.col("o_orderkey") % 30).alias("b"))


SPANS = """spans AS (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS a,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 AS BIGINT) AS b FROM orders)"""
