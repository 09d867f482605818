"""Checks and relaxations on typed graphs, held as a table of vertices and a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaframe.session import cut as _cut

#: Rounds of relaxation between two checkpoints.
ROUNDS = 4


def roots(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices ``id`` that no edge (src, dst) enters."""
    return vertices.join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """(lo, hi, n): edges regardless of direction, with how often each occurs; self-loops stay."""
    return edges.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).groupBy("lo", "hi").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, vertex) -> DataFrame:
    """The vertices one step away from one, either way."""
    there = edges.where(F.col("src") == vertex).select(F.col("dst").alias("id"))
    return there.union(edges.where(F.col("dst") == vertex).select(F.col("src").alias("id"))).where(F.col("id") != vertex).distinct()


def common_parents(edges: DataFrame) -> DataFrame:
    """(a, b, n): pairs a < b with n common parents. A parent's children are paired, so parents must have few."""
    one, two = edges.select("src", F.col("dst").alias("a")).distinct(), edges.select("src", F.col("dst").alias("b")).distinct()
    return one.join(two, "src").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def cycles(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(id, least): the vertices on directed cycles of a graph in which each vertex has one successor at most,
    with the least vertex of their cycle.

    Each round every vertex jumps twice as far and keeps the least vertex that it passed, so after
    log2 n rounds each has ended on a cycle if there is one ahead; those that are jumped to lie on it.
    """
    n = edges.select("src").distinct().count()
    jump, steps = _cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.least("src", "dst").alias("least"))), 1
    while steps <= n and max_rounds:
        far = jump.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
        jump = _cut(jump.join(far, "to").select("id", F.col("to2").alias("to"), F.least("least", "least2").alias("least")))
        steps, max_rounds = steps * 2, max_rounds - 1
    return jump.join(jump.select(F.col("to").alias("id")).distinct(), "id", "left_semi").select("id", "least")


def acyclic_violations(edges: DataFrame) -> DataFrame:
    """The vertices of a general graph on or between directed cycles: what is left after removing, again and
    again, edges out of vertices that none enters and into vertices that none leaves."""
    now, size, was = _cut(edges.select("src", "dst").distinct()), -1, -2
    while size != was:
        entered = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        now = _cut(entered.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        size, was = now.count(), size
    return now.select(F.col("src").alias("id")).distinct()


def cycle_paths(edges: DataFrame, max_length: int = 8) -> DataFrame:
    """(path): each directed cycle of up to ``max_length`` edges once, as the array of its vertices from the least one.

    What no cycle can hold is cut off first. Then paths grow by an edge a round from their least vertex, never
    through a vertex twice, until none is left to grow; a graph with dense parts has very many cycles, of which
    ``max_length`` keeps the short ones.
    """
    core = acyclic_violations(edges)
    inner = _cut(edges.select("src", "dst").distinct().join(core.select(F.col("id").alias("src")), "src", "left_semi").join(core.select(F.col("id").alias("dst")), "dst", "left_semi"))
    found = inner.where("src = dst").select(F.array("src").alias("path"))
    open_ = _cut(inner.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("here")))
    for _ in range(max_length - 1):
        if open_.isEmpty():
            break
        grown = _cut(open_.join(inner.select(F.col("src").alias("here"), F.col("dst").alias("next")), "here").where(F.col("next") >= F.get("path", F.lit(0))))
        found = found.union(grown.where(F.col("next") == F.get("path", F.lit(0))).select("path"))
        onward = grown.where((F.col("next") != F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("next")))
        open_ = onward.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("here"))
    return found


def relax(vertices: DataFrame, edges: DataFrame, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """(id, value): unknown (null) values become the mean of their neighbours', known ones stay.

    All vertices move at once in each round, until none moves by more than ``tolerance``, or for
    ``max_rounds``, after which values are returned as near as they have come. A vertex that no known
    value reaches is an error.
    """
    both = _cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct())
    now = _cut(vertices.select("id", "value", F.col("value").isNotNull().alias("known")))
    for _ in range(-(-max_rounds // ROUNDS)):
        for _ in range(ROUNDS):
            means = both.join(now.where("value IS NOT NULL").select(F.col("id").alias("dst"), F.col("value").alias("_v")), "dst").groupBy(F.col("src").alias("id")).agg(F.avg("_v").alias("_mean"))
            moved = F.when(F.col("known"), F.col("value")).otherwise(F.coalesce("_mean", "value"))
            now = now.select("id", "value", "known").join(means, "id", "left").select("id", moved.alias("value"), "known", F.col("value").alias("_was"))
        now = _cut(now)
        most, fresh = now.agg(F.max(F.abs(F.col("value") - F.col("_was"))), F.count(F.when(F.col("value").isNotNull() & F.col("_was").isNull(), 1))).first()
        if not fresh and (most or 0) <= tolerance:
            break
    if lost := now.where("value IS NULL").count():
        raise ValueError(f"{lost} vertices are reached by no known value")
    return now.select("id", "value")


def cardinality(edges: DataFrame, limits: dict[str, int], kind: str = "kind") -> DataFrame:
    """(id, kind, n, allowed): vertices that more edges of a kind enter than allowed."""
    allowed = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    counts = edges.groupBy(F.col("dst").alias("id"), kind).agg(F.count("*").alias("n"))
    return counts.withColumn("allowed", F.element_at(allowed, F.col(kind))).where(F.col("n") > F.col("allowed"))
