"""Ranks and order statistics. Equal values share a rank (1, 2, 2, 4) and input order breaks ties.

A window over a whole table runs in one task. Global ranks are therefore prefix sums over distinct
values in buckets between approximate quantiles, of which only the bucket totals meet in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.session import cut as _cut

BUCKETS = 64


def running_total(df: DataFrame, by: str, amount: str, name: str, descending: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``name``, the sum of ``amount`` over all rows that come before by the number ``by``; values of ``by`` are distinct."""
    bounds = df.agg(F.percentile_approx(by, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda x: x < F.col(by))) if bounds else F.lit(0)
    tagged = df.withColumn("_bucket", bucket)
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = tagged.groupBy("_bucket").agg(F.sum(amount).alias("_sum"))
    base = totals.select("_bucket", F.coalesce(F.sum("_sum").over(Window.orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_bucket").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``buckets`` rows are broadcast
    return tagged.join(F.broadcast(base), "_bucket").withColumn(name, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).drop("_bucket", "_base")


def competition_rank(df: DataFrame, value: str, descending: bool = True, eligible: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with rank, total (eligible rows) and tied; null where a row isn't eligible or the value is null."""
    fit = F.col(value).isNotNull() if eligible is None else F.col(value).isNotNull() & eligible
    counts = df.where(fit).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, "_value", "_n", "_before", descending, buckets)
    total = counts.agg(F.sum("_n").alias("total"))
    marks = ranked.join(F.broadcast(total)).select("_value", (F.col("_before") + 1).alias("rank"), "total", (F.col("_n") > 1).alias("tied"))
    return df.withColumn("_fit", F.when(fit, F.col(value))).join(marks, F.col("_fit") == F.col("_value"), "left").drop("_fit", "_value")


def leaders(ranked: DataFrame) -> DataFrame:
    """All rows at rank 1."""
    return ranked.where("rank = 1")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order that ends with a unique column, so that it is stable; cuts inside ties."""
    return df.orderBy(*order).limit(k)


def row_rank(df: DataFrame, name: str, order: list[Column], within: list[str]) -> DataFrame:
    """``df`` with each row's number in an order, counted from 1 in each group of ``within``; the order should end with a unique column.

    Rows are sorted over range partitions and numbered inside them; only the partitions' sizes meet in one
    place, and a group may be spread over many partitions.
    """
    # The id that Spark gives a row is its partition, times 2^33, plus its place there.
    placed = _cut(df.orderBy(*within, *order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    numbered = placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_base")
    if not within:
        return numbered
    first = numbered.groupBy(*(F.col(c).alias(f"_{c}") for c in within)).agg((F.min(name) - 1).alias("_before"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within))
    return numbered.join(first, same).withColumn(name, F.col(name) - F.col("_before")).drop("_before", *(f"_{c}" for c in within))


def neighbours(df: DataFrame, column: str, order: list[Column], within: list[str]) -> DataFrame:
    """``df`` with prev_ and next_ of a column in order; null at the ends."""
    w = Window.partitionBy(*within).orderBy(*order)
    return df.withColumn(f"prev_{column}", F.lag(column).over(w)).withColumn(f"next_{column}", F.lead(column).over(w))


def viewport(scroll_top: int, height: int, rows: int, row: int = 24, overscan: int = 12, step: int = 8) -> tuple[int, int]:
    """The rows [start, end) that a scrolled list shows, quantised by ``step``."""
    first, last = scroll_top // row - overscan, -(-(scroll_top + height) // row) + overscan
    return max(0, first // step * step), min(rows, -(-last // step) * step)


def page(df: DataFrame, start: int, end: int, *order: Column) -> DataFrame:
    """Rows [start, end) of an order."""
    return df.orderBy(*order).offset(start).limit(end - start)
