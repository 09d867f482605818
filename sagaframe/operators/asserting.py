"""Assertions that run inside the plan they guard: a violation fails the query itself, without an action of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _true(holds: Column, told: Column) -> Column:
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def require(df: DataFrame, of: DataFrame, holds: Column, told: Column) -> DataFrame:
    """``df``, if the aggregate ``holds`` over ``of``; else the query that reads it fails with ``told``.

    The aggregate is a scalar subquery of a filter, so it combines in the tasks and one row comes of it; it is
    worked out before ``df`` is read, and for an empty ``df`` as well.
    """
    return df.where(of.agg(_true(holds, told).alias("holds")).scalar())


def sized(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """``df``, which must have n rows."""
    return require(df, df, F.count("*") == n, F.concat(F.count("*").cast("string"), F.lit(f" {what}, not {n}")))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, which must have no two rows of equal keys. Counts combine before their shuffle, so a hot key does no harm."""
    counts = df.groupBy(F.struct(*keys).alias("_key")).agg(F.count("*").alias("_n"))
    most = F.coalesce(F.max("_n"), F.lit(0))
    return require(df, counts, most <= 1, F.concat(F.to_json(F.max_by("_key", "_n")), F.lit(" occurs "), most.cast("string"), F.lit(" times")))


def each(df: DataFrame, good: Column, told: Column) -> DataFrame:
    """``df``, of which every row must be good; the first that isn't (null isn't) fails with ``told``.

    The row's number in its task keeps the optimiser from asking rows that a join or filter before this leaves out.
    """
    return df.where(_true(good & (F.monotonically_increasing_id() >= 0), F.coalesce(told, F.lit("a row isn't as it must be"))))


def zipped(left: Column, right: Column, what: str) -> Column:
    """The members of two arrays by their places, which must be as many: structs of ``left`` and ``right``."""
    both = F.transform(left, lambda x, i: F.struct(x.alias("left"), F.get(right, i).alias("right")))
    return F.when(F.size(left) == F.size(right), both).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.size(right).cast("string"), F.lit(" for "), F.size(left).cast("string"))))
