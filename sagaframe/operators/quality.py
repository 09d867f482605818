"""Data-quality rules. A rule is a query of violations (key, detail); a suite adds allow-lists and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "rule string, severity string, key string, detail string"


@dataclass
class Rule:
    """``find`` gives rows with key and detail; keys of ``allowed`` are known and don't count."""

    name: str
    severity: str
    find: Callable[[], DataFrame]
    allowed: tuple[str, ...] = field(default=())


def where(df: DataFrame, key: str, bad: Column, detail: Column | str) -> DataFrame:
    """Violations of a row predicate."""
    return df.where(bad).select(F.col(key).cast("string").alias("key"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def unique(df: DataFrame, key: str) -> DataFrame:
    found = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.col(key).cast("string").alias("key"), F.concat(F.lit("occurs "), F.col("n"), F.lit(" times")).alias("detail"))


def matches(df: DataFrame, key: str, column: str, pattern: str, required: bool = True) -> DataFrame:
    bad = ~F.col(column).rlike(pattern)
    return where(df, key, F.coalesce(bad, F.lit(required)), F.concat(F.lit(f"{column} is "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def vocabulary(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    return where(df, key, F.col(column).isNotNull() & ~F.col(column).isin(values), F.concat(F.lit(f"{column} is "), F.col(column)))


def subset(df: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """Arrays with members outside of a vocabulary."""
    return where(df, key, F.size(F.array_except(column, F.array(*map(F.lit, values)))) > 0, f"{column} has other members")


def suite(rules: list[Rule]) -> DataFrame:
    """All violations (rule, severity, key, detail). An allowed key that no longer violates its rule is itself a warning."""
    parts = []
    for rule in rules:
        found = rule.find()
        listed = list(rule.allowed)
        parts.append(found.where(~F.col("key").isin(listed) if listed else F.lit(True)).select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "key", "detail"))
        if listed:
            known = found.sparkSession.createDataFrame([(x,) for x in listed], "key string")
            parts.append(known.join(found.select("key").distinct(), "key", "left_anti").select(F.lit(rule.name).alias("rule"), F.lit("warning").alias("severity"), "key", F.lit("stale allow-list entry").alias("detail")))
    return reduce(DataFrame.union, parts)


def summary(violations: DataFrame) -> DataFrame:
    return violations.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def first_reports(violations: DataFrame, k: int = 20) -> DataFrame:
    """The first k violations, as a report prints them."""
    return violations.orderBy("rule", "key", "detail").limit(k)


def passed(violations: DataFrame) -> bool:
    """Whether no violation is an error: what a command's exit code tells."""
    return violations.where(F.col("severity") == "error").isEmpty()


def unknown_fields(raw: DataFrame, json: str, key: str, known: list[str]) -> DataFrame:
    """Keys of a JSON object's top level that a strict schema doesn't have."""
    extra = F.array_except(F.json_object_keys(json), F.array(*map(F.lit, known)))
    return raw.select(F.col(key).cast("string").alias("key"), F.explode(extra).alias("_k")).select("key", F.concat(F.lit("unknown key "), F.col("_k")).alias("detail"))


def walk(df: DataFrame, value: Column, key: str, depth: int = 8) -> DataFrame:
    """(key, path, name, text): every member of a nested JSON value, found by unrolling ``depth`` levels of VARIANT.

    A value that has members below the last level is an error, so that none is left unread.
    """
    level = df.select(F.col(key).cast("string").alias("key"), F.lit("").alias("path"), value.alias("_v"))
    parts = []
    for n in range(depth):
        view = f"_walk_{uuid.uuid4().hex}"
        level.createOrReplaceTempView(view)
        members = level.sparkSession.sql(f"SELECT w.key, w.path, e.pos, e.key AS name, e.value AS _v FROM {view} w, LATERAL variant_explode(w._v) e")
        if n == depth - 1:
            deeper = F.schema_of_variant("_v").rlike("^(OBJECT<.|ARRAY<(?!VOID>))")
            members = members.withColumn("_v", F.when(deeper, F.raise_error(F.concat(F.lit(f"members below level {depth} of "), "path"))).otherwise(F.col("_v")))
        step = F.coalesce("name", F.concat(F.lit("["), F.col("pos"), F.lit("]")))
        level = members.select("key", F.concat("path", F.lit("/"), step).alias("path"), "name", "_v")
        parts.append(level.select("key", "path", "name", F.expr("try_variant_get(_v, '$', 'string')").alias("text")))
    return reduce(DataFrame.union, parts)
