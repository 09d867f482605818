"""Group profiles, distributions and reconciliations with first-wins ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round to a whole number, halves up (-2.5 becomes -2)."""
    return F.floor(x + 0.5).cast("long")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(half_up(100 * part / whole)).cast("long")


def first_best(value: Column, name: Column, order: Column, largest: bool = True) -> Column:
    """Aggregate: ``name`` of the row with the largest (least) value; of equal rows the first in ``order``."""
    return F.min_by(name, F.struct(-value if largest else value, order))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def group_profile(df: DataFrame, key: str, value: str, name: str, order: str, category: str, categories: list[str]) -> DataFrame:
    """For each key: n, mean, the first row with the longest value, a zero-filled count for each category, first place."""
    counts = [count_if(F.col(category) == c).alias(f"n_{i}") for i, c in enumerate(categories)]
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), first_best(F.col(value), F.col(name), F.col(order)).alias("longest"), *counts, F.min(order).alias("first_place"))


def overview(df: DataFrame, value: str, name: str, order: str, category: str) -> DataFrame:
    """One row: n, mean, names of the first largest and least, and the commonest category with count and share."""
    v, o = F.col(value), F.col(order)
    whole = df.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), first_best(v, F.col(name), o).alias("largest"), first_best(v, F.col(name), o, False).alias("least"))
    mode = df.groupBy(F.col(category).alias("mode")).agg(F.count("*").alias("mode_n"), F.min(order).alias("_o")).orderBy(F.desc("mode_n"), "_o").limit(1).drop("_o")
    return whole.join(mode).withColumn("mode_percent", percent(F.col("mode_n"), F.col("n")))  # one row each


def ordered(spark, values: list[str], column: str) -> DataFrame:
    """A curated order as a small table (column, pos)."""
    return spark.createDataFrame(list(enumerate(values)), "pos long, v string").select(F.col("v").alias(column), "pos")


def distribution(df: DataFrame, category: str, order: list[str]) -> DataFrame:
    """(category, n, percent, pos) of the categories present, in a fixed order, those that it doesn't list last; percent of all rows."""
    counts = df.groupBy(category).agg(F.count("*").alias("n")).join(F.broadcast(ordered(df.sparkSession, order, category)), category, "left").withColumn("pos", F.coalesce("pos", F.lit(len(order)).cast("long")))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all")))).withColumn("percent", percent(F.col("n"), F.col("_all"))).drop("_all")


def place(c: Column, order: list[str]) -> Column:
    """The place of a value in a curated order, from 0; the plan fails at a value that the order doesn't have."""
    found = F.array_position(F.array(*map(F.lit, order)), c).cast("int")
    return F.when(found > 0, found - 1).otherwise(F.raise_error(F.concat(F.lit("not in the order: "), F.coalesce(c, F.lit("null")))))


def by_field(hits: DataFrame, field: str, *taken: str) -> DataFrame:
    """(field, n, hits) of findings by the field's name before its first index; the hits, of which a report has few, in order."""
    return hits.groupBy(F.substring_index(field, "[", 1).alias(field)).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*taken))).alias("hits"))


def pivot_shares(df: DataFrame, key: str, category: str, categories: list[str]) -> DataFrame:
    """Group by category counts, zero-filled in a fixed order, with percents of the row's total."""
    wide = df.groupBy(key).agg(*(count_if(F.col(category) == c).alias(f"n_{i}") for i, c in enumerate(categories)), F.count("*").alias("n"))
    return wide.select("*", *(percent(F.col(f"n_{i}"), F.col("n")).alias(f"p_{i}") for i in range(len(categories))))


def ambiguous(df: DataFrame, key: str, other: str) -> DataFrame:
    """Keys that go with more than one value of ``other``."""
    return df.groupBy(key).agg(F.count_distinct(other).alias("n")).where("n > 1")


def pool(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, first) with first the place where the key appears first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def runs(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Maximal runs of equal ``state`` in order: keys, state, run (from 1), first, last and n. Nulls are a state of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"))
    marked = df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w))
    return marked.groupBy(*keys, "run", state).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def duplicates(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_wins(*sources: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of several tables of which the later one counts."""
    tagged = [s.select(key, value, F.lit(i).alias("_i")) for i, s in enumerate(sources)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.union(t)
    return every.groupBy(key).agg(F.max_by(value, "_i").alias(value))


def reconcile(stored: DataFrame, parts: DataFrame, key: str, total: str, part: str, tolerance: float) -> DataFrame:
    """Keys whose stored total differs from the sum of their parts, with both; a key without parts sums to 0."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("recomputed"), F.count("*").alias("n_parts"))
    joined = stored.select(key, F.col(total).alias("stored")).join(sums, key, "left").withColumn("recomputed", F.coalesce("recomputed", F.lit(0.0))).withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    return joined.where(F.abs(F.col("stored") - F.col("recomputed")) > tolerance)
