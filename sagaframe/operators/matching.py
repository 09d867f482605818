"""Joins that Spark has no operator for, and integrity checks built on joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_RANGES, BUCKETS = 1_000_000, 64


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int, closed: bool = True) -> DataFrame:
    """Pairs of intervals [a, b] and [ra, rb] of equal keys that overlap; open intervals with closed=False.

    Both sides go to all buckets of ``width`` units that they touch, which makes it an equi-join; the
    pair counts only in the bucket where the later of both starts lies. Rows on either side multiply by
    length / width + 1, so the width should be about the usual length.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    paired = left.withColumn("_k", bucket("a", "b")).join(right.withColumn("_k", bucket("ra", "rb")), [*keys, "_k"])
    meet = (F.col("ra") <= F.col("b")) & (F.col("rb") >= F.col("a")) if closed else (F.col("ra") < F.col("b")) & (F.col("rb") > F.col("a"))
    return paired.where(meet & (F.floor(F.greatest("a", "ra") / width) == F.col("_k"))).drop("_k")


def near(left: DataFrame, right: DataFrame, x: str, y: str, keys: list[str], distance: int) -> DataFrame:
    """Pairs with |x - y| <= distance of equal keys, by buckets of that width: the right side goes to three of them."""
    cell = F.floor(F.col(y) / distance)
    spread = right.withColumn("_k", F.explode(F.array(cell - 1, cell, cell + 1)))
    return left.withColumn("_k", F.floor(F.col(x) / distance)).join(spread, [*keys, "_k"]).where(F.abs(F.col(x) - F.col(y)) <= distance).drop("_k")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str], forward: bool = False) -> DataFrame:
    """``left`` with ``take`` of the right row of equal keys that is the last at or before ``at`` (the first at or after).

    One shuffle: both sides are united and the last right row is carried along each key. Of right rows
    at the same place the one with the greatest ``take`` counts (the least, forward).
    """
    value = F.struct(*(F.col(c) for c in take))
    tagged = left.withColumn("_v", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("_right", F.lit(False))
    other = right.select(*keys, at, value.alias("_v")).withColumn("_right", F.lit(True))
    both = tagged.unionByName(other, allowMissingColumns=True)
    order = [F.desc(at), F.desc("_right"), F.desc("_v")] if forward else [F.asc(at), F.desc("_right"), F.asc("_v")]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where(~F.col("_right"))
    return found.select(*left.columns, *(F.col(f"_found.{c}").alias(c) for c in take))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """``left`` with the nearest right row's place and ``take`` as near_*; an earlier row wins against a later one as near."""
    moved = right.withColumn("_place", F.col(at))
    back = asof(left, moved, keys, at, ["_place", *take])
    names = {c: f"_back_{c}" for c in ["_place", *take]}
    both = asof(back.withColumnsRenamed(names), moved, keys, at, ["_place", *take], forward=True)
    first = (F.col(at) - F.col("_back__place") <= F.col("_place") - F.col(at)) | F.col("_place").isNull()
    choose = lambda c: F.when(F.col("_back__place").isNotNull() & first, F.col(f"_back_{c}")).otherwise(F.col(c))
    return both.select(*left.columns, choose("_place").alias("near_at"), *(choose(c).alias(f"near_{c}") for c in take))


def nearest_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """``points`` with near_a, near_b and ``take`` (near_*) of the nearest span [a, b] of equal keys, and its ``distance``, 0 inside.

    Of spans as near the first by a, b and ``take`` wins. Only spans that end later than all before them can
    win, and their ends rise with their starts: so the first of them that ends at or after the point, and the
    last that ends before it, are all there is to compare, two as-of joins instead of all pairs.
    """
    order = Window.partitionBy(*keys).orderBy("a", "b", *(c for c in take if c not in ("a", "b")))
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rising = spans.withColumn("_reach", reach).where("_reach IS NULL OR b > _reach").select(*keys, F.col("b").alias(at), F.struct("b", "a", *(F.col(c).alias(f"_{c}") for c in take)).alias("_span"))
    back = asof(points, rising, keys, at, ["_span"]).withColumnRenamed("_span", "_back")
    both = asof(back, rising, keys, at, ["_span"], forward=True)
    after, before = F.greatest(F.col("_span.a") - F.col(at), F.lit(0)), F.col(at) - F.col("_back.b")
    best = F.when(F.col("_back").isNotNull() & (F.col("_span").isNull() | (before <= after) & (after > 0)), F.col("_back")).otherwise(F.col("_span"))
    told = both.withColumn("_best", best)
    distance = F.greatest(F.col("_best.a") - F.col(at), F.col(at) - F.col("_best.b"), F.lit(0))
    return told.select(*points.columns, F.col("_best.a").alias("near_a"), F.col("_best.b").alias("near_b"), F.when(F.col("_best").isNotNull(), distance).alias("distance"), *(F.col(f"_best._{c}").alias(f"near_{c}") for c in take))


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, take: list[str], bound: int = BROADCAST_RANGES, buckets: int = BUCKETS) -> DataFrame:
    """``points`` with ``take`` of the range [a, b] that holds ``at``, null outside of all; ranges don't overlap.

    Up to ``bound`` ranges go to the tasks as sorted arrays of 16 bytes a range and are searched by halving;
    more are dealt into buckets between quantiles of their starts, each of which joins its points as of the
    last start.
    """
    if ranges.count() <= bound:
        held = ranges.select("a", "b").orderBy("a").toPandas()
        starts, stops = held["a"].to_numpy(), held["b"].to_numpy()

        @F.pandas_udf("long")
        def start(x: pd.Series) -> pd.Series:
            i = np.searchsorted(starts, x.to_numpy(), side="right") - 1
            inside = (i >= 0) & (x.to_numpy() <= stops[i]) if len(starts) else np.zeros(len(x), bool)
            return pd.Series(starts[i] if len(starts) else np.zeros(len(x), np.int64)).where(inside).astype("Int64")

        found = points.withColumn("_a", F.when(F.col(at).isNotNull(), start(F.coalesce(F.col(at), F.lit(0)).cast("long"))))
        return found.join(ranges.select(F.col("a").alias("_a"), *take), "_a", "left").select(*points.columns, *take)
    edges = sorted(set(ranges.agg(F.percentile_approx("a", [i / buckets for i in range(1, buckets)], 10_000)).first()[0]))
    bucket = lambda c: F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x <= F.col(c)))
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(bucket("a"), bucket("b")))).select("_bucket", F.col("a").alias(at), F.col("b").alias("_b"), *take)
    found = asof(points.withColumn("_bucket", bucket(at)), spread, ["_bucket"], at, ["_b", *take])
    return found.select(*points.columns, *(F.when(F.col(at) <= F.col("_b"), F.col(c)).alias(c) for c in take))


def parallel_row(points: DataFrame, spans: DataFrame, at: str, row: str, take: list[str], width: int, down: bool = True) -> DataFrame:
    """``points`` with near_row, near_a and ``take`` (near_*) of the span [a, b] in the nearest row below (above) their own
    that holds ``at`` or ended just before it; of several in that row the first by a and ``take``. Points need a column ``id``."""
    held = spans.select(F.col("a").alias("ra"), (F.col("b") + 1).alias("rb"), F.col("row").alias("_row"), F.struct("a", *take).alias("_span"))
    met = overlaps(points.select("id", row, F.col(at).alias("a"), F.col(at).alias("b")), held, [], width)
    apart = F.col("_row") - F.col(row) if down else F.col(row) - F.col("_row")
    best = met.where(apart > 0).groupBy("id").agg(F.min_by(F.struct("_row", "_span"), F.struct(apart, "_span")).alias("_best"))
    return points.join(best, "id", "left").select(*points.columns, F.col("_best._row").alias("near_row"), F.col("_best._span.a").alias("near_a"), *(F.col(f"_best._span.{c}").alias(f"near_{c}") for c in take))


def next_in_row(spans: DataFrame, row: str, group: str, forward: bool = True) -> DataFrame:
    """``spans`` with the ``group`` and distance of the nearest span of another group in their row that begins behind their end
    (ends before their start)."""
    place, other = ("b", "a") if forward else ("a", "b")
    # a span's own group mustn't hide the others: with each place go the nearest group from there on and the nearest other one
    at = spans.groupBy(row, other).agg(F.min(group).alias("_lo"), F.max(group).alias("_hi"))
    from_far = Window.partitionBy(row).orderBy(F.desc(other) if forward else F.asc(other))
    last = lambda c: F.lag(c).over(from_far)
    differs = F.when(last("_lo") != F.col("_lo"), last("_lo")).when(last("_hi") != F.col("_lo"), last("_hi"))
    carried = at.withColumn("_far", F.when(differs.isNotNull(), F.struct(differs.alias("g"), last(other).alias("x"))))
    beyond = F.last("_far", ignorenulls=True).over(from_far.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = lambda c: F.struct(F.col(c).alias("g"), F.col(other).alias("x"))
    two = carried.withColumn("_one", here("_lo")).withColumn("_two", F.when(F.col("_lo") != F.col("_hi"), here("_hi")).otherwise(beyond))
    step = 1 if forward else -1
    asked = spans.withColumn("_at", F.col(place) + step)
    near = asof(asked, two.withColumnRenamed(other, "_at").select(row, "_at", "_one", "_two"), [row], "_at", ["_one", "_two"], forward=forward)
    best = F.when(F.col("_one.g") != F.col(group), F.col("_one")).otherwise(F.col("_two"))
    return near.select(*spans.columns, best["g"].alias("near_group"), F.abs(best["x"] - F.col(place)).alias("distance"))


def with_lists(df: DataFrame, other: DataFrame, on: str, order: str, value: str, name: str) -> DataFrame:
    """``df`` with an array of the other side's values in order, empty where it has none."""
    lists = other.groupBy(on).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))
    return df.join(lists, on, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def restored(given: dict[str, str], domains: dict[str, list[str]]) -> dict[str, str]:
    """The filters that a caller's parameters ask for: those with a known name and a value of its domain."""
    return {name: value for name, value in given.items() if value in domains.get(name, ())}


def containing_else_latest(points: DataFrame, spans: DataFrame, keys: list[str], at: str, take: list[str]) -> DataFrame:
    """``points`` with the span of equal keys that holds them, else the latest begun, else the first.

    Spans of one key don't overlap, so the latest begun is the only one that can hold the point.
    """
    begun = asof(points, spans.withColumn(at, F.col("a")).withColumn("_b", F.col("b")), keys, at, ["_b", *take])
    first = spans.groupBy(*keys).agg(*(F.min_by(c, "a").alias(f"_first_{c}") for c in take))
    joined = begun.join(first, keys, "left")
    return joined.select(*points.columns, (F.col(at) <= F.col("_b")).alias("inside"), *(F.coalesce(c, f"_first_{c}").alias(c) for c in take))


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(*on).distinct(), on, "left_anti")


def strict_lookup(df: DataFrame, lookup: DataFrame, on: str, take: str) -> DataFrame:
    """``df`` with ``take``; the plan fails at the first key that the lookup doesn't have."""
    joined = df.join(lookup.select(on, take), on, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {take} for {on} "), F.coalesce(F.col(on).cast("string"), F.lit("null"))))
    return joined.withColumn(take, F.when(F.col(take).isNull(), missing).otherwise(F.col(take)))


def coverage(curated: DataFrame, data: DataFrame, on: str) -> DataFrame:
    """(on, n_curated, n_data, status): status is both, missing (not curated), stale (not in the data) or repeated."""
    sides = curated.groupBy(on).agg(F.count("*").alias("n_curated")).join(data.groupBy(on).agg(F.count("*").alias("n_data")), on, "full")
    c, d = F.coalesce("n_curated", F.lit(0)), F.coalesce("n_data", F.lit(0))
    status = F.when(c == 0, "missing").when(d == 0, "stale").when(c > 1, "repeated").otherwise("both")
    return sides.select(on, c.alias("n_curated"), d.alias("n_data"), status.alias("status"))


def existence_flag(df: DataFrame, other: DataFrame, on: str, name: str) -> DataFrame:
    marks = other.select(on).distinct().withColumn(name, F.lit(True))
    return df.join(marks, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def optional_filters(df: DataFrame, **wanted: str) -> DataFrame:
    """Equality filters of which 'all' lets everything through."""
    conditions: list[Column] = [F.col(c) == v for c, v in wanted.items() if v != "all"]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def ranked_filter(df: DataFrame, value: str, collapse_zeros: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with a value (and, if asked, not 0), and one row with how many were left out as null and as zero."""
    zero = F.lit(collapse_zeros) & (F.col(value) == 0)
    left_out = df.agg(F.count(F.when(F.col(value).isNull(), 1)).alias("n_null"), F.count(F.when(zero, 1)).alias("n_zero"))
    return df.where(F.col(value).isNotNull() & ~zero), left_out


def ledger(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, status, state): known keys keep their status, new ones are pending, and those gone are stale."""
    joined = current.select(key, F.lit(True).alias("_now")).join(known.select(key, "status"), key, "full")
    state = F.when(F.col("_now").isNull(), "stale").when(F.col("status").isNull(), "new").when(F.col("status") == "unresolved", "retry").otherwise("known")
    return joined.select(key, F.coalesce("status", F.lit("pending")).alias("status"), state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put over those of equal key."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns))
