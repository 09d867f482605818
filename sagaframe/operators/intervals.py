"""Closed intervals of whole numbers (days, years) [a, b]: merging, counting, gaps, clipping, cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.operators.ranking import BUCKETS, running_total


def merge(df: DataFrame, keys: list[str], gap: int = 1) -> DataFrame:
    """Maximal spans (keys, a, b, n) of each key; intervals at most ``gap`` apart go together (1: adjacent ones do)."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = df.withColumn("_new", (reach.isNull() | (F.col("a") > reach + gap)).cast("int"))
    return new.withColumn("_span", F.sum("_new").over(w)).groupBy(*keys, "_span").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n")).drop("_span")


def islands(df: DataFrame, keys: list[str], name: str, touching: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``name``, the start of the island of overlapping intervals that each row belongs to in its key.

    An island begins where a start lies behind the ends of all intervals before it by start, or, with
    ``touching``, on the last of them; two that begin at one place share their name. Rows are dealt into
    buckets between quantiles of all starts, and what is carried from bucket to bucket are two numbers, the
    last end and the last beginning, so a key of any size goes over many tasks.
    """
    edges = sorted(set(df.agg(F.percentile_approx("a", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < F.col("a"))) if edges else F.lit(0)
    # a struct, unlike its fields, is never null and equals another with the same nulls
    rows = df.withColumn("_key", F.struct(*keys)).withColumn("_bucket", bucket)
    # equal rows stand in any order, and in another one after a join: what begins at the first of them counts for all
    inside = Window.partitionBy("_key", "_bucket").orderBy(F.asc("a"), F.desc("b"))

    def carried(rows: DataFrame, value: str) -> DataFrame:
        top = rows.groupBy("_key", "_bucket").agg(F.max(value).alias("_top"))
        earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        return rows.join(top.select("_key", "_bucket", F.max("_top").over(earlier).alias("_base")), ["_key", "_bucket"])

    reach = F.greatest("_base", F.max("b").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    reached = carried(rows, "b").withColumn("_reach", reach).drop("_base")
    behind = F.col("a") >= F.col("_reach") if touching else F.col("a") > F.col("_reach")
    begun = carried(reached.withColumn("_begins", F.when(F.col("_reach").isNull() | behind, F.col("a"))).drop("_reach"), "_begins")
    last = F.greatest("_base", F.max("_begins").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return begun.withColumn(name, last).select(*df.columns, name)


def concurrency(df: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Steps (keys, at, n): from ``at`` on n intervals hold, by summing +1 at starts and -1 behind ends.

    Without keys the running sum goes over buckets of the axis instead of one window.
    """
    keys = keys or []
    edges = df.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("d")))))
    steps = edges.groupBy(*keys, "at").agg(F.sum("d").alias("d"))
    if keys:
        return steps.withColumn("n", F.sum("d").over(Window.partitionBy(*keys).orderBy("at"))).drop("d")
    return running_total(steps, "at", "d", "n", buckets=buckets).withColumn("n", F.col("n") + F.col("d")).drop("d")


def units(df: DataFrame) -> DataFrame:
    """One row ``at`` for each unit of each interval. For short intervals; long ones are better counted by ``concurrency``."""
    return df.withColumn("at", F.explode(F.sequence("a", "b")))


def gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) between merged spans."""
    w = Window.partitionBy(*keys).orderBy("a")
    return spans.select(*keys, (F.lag("b").over(w) + 1).alias("_a"), (F.col("a") - 1).alias("b")).where("_a <= b").withColumnRenamed("_a", "a").select(*keys, "a", "b")


def clip(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Intersections [a, b] of intervals with equal keys; the right's bounds are ra and rb."""
    return left.join(right, on).where("ra <= b AND rb >= a").withColumn("a2", F.greatest("a", "ra")).withColumn("b2", F.least("b", "rb"))


def cut(df: DataFrame, cuts: Column) -> DataFrame:
    """Pieces of each interval, cut in front of each number c of the array ``cuts`` with a < c <= b."""
    inside = F.filter(F.array_distinct(F.array_sort(cuts)), lambda c: (c > F.col("a")) & (c <= F.col("b")))
    starts = F.concat(F.array("a"), inside)
    pieces = F.transform(starts, lambda x, i: F.struct(x.alias("pa"), F.coalesce(F.get(starts, i + 1) - 1, F.col("b")).alias("pb")))
    return df.select("*", F.inline(pieces))


def label_years(first: Column, last: Column, label) -> Column:
    """One year, or both joined by a dash."""
    return F.when(first == last, label(first)).otherwise(F.concat(label(first), F.lit("–"), label(last)))
