"""Nearest spans, points in ranges, cycles with their paths and distributed row numbers against plain versions."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sagaframe.operators import graph, matching, ranking


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_span(spark, seed):
    r = random.Random(seed)
    spans = [(r.randrange(3), a, a + r.randrange(0, 25), i) for i in range(60) for a in [r.randrange(200)]]
    points = [(r.randrange(4), r.randrange(-20, 260), i) for i in range(150)]
    df = matching.nearest_span(spark.createDataFrame(points, "k int, at long, p int"), spark.createDataFrame(spans, "k int, a long, b long, s int"), ["k"], "at", ["s"])
    want = {}
    for k, at, p in points:
        best = min(((max(a - at, at - b, 0), a, b, s) for kk, a, b, s in spans if kk == k), default=(None,) * 4)
        want[p] = best
    assert {x["p"]: (x["distance"], x["near_a"], x["near_b"], x["near_s"]) for x in df.collect()} == want


@pytest.mark.parametrize("bound", [1000, 0])
def test_points_in_ranges(spark, bound):
    r = random.Random(3)
    starts = sorted(r.sample(range(0, 3000, 7), 150))
    ranges = [(a, a + r.randrange(0, 7), f"r{a}") for a in starts]
    points = [(i, r.randrange(-10, 3100) if i else None) for i in range(600)]
    got = matching.in_ranges(spark.createDataFrame(points, "i int, at long"), spark.createDataFrame(ranges, "a long, b long, lane string"), "at", ["lane"], bound)
    assert {x["i"]: x["lane"] for x in got.collect()} == {i: next((n for a, b, n in ranges if at is not None and a <= at <= b), None) for i, at in points}
    if bound:
        none = matching.in_ranges(spark.createDataFrame(points, "i int, at long"), spark.createDataFrame([], "a long, b long, lane string"), "at", ["lane"])
        assert none.where("lane IS NOT NULL").count() == 0 and none.count() == 600


def test_cycle_paths(spark):
    r = random.Random(4)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(26)} | {(100 + i, 101 + i) for i in range(5)} | {(7, 7)}
    want = set()

    def walk(path):
        for a, b in edges:
            if a == path[-1]:
                if b == path[0]:
                    want.add(tuple(path))
                elif b > path[0] and b not in path and len(path) < 6:
                    walk([*path, b])

    for v in {a for a, _ in edges}:
        walk([v])
    got = [tuple(x["path"]) for x in graph.cycle_paths(spark.createDataFrame(list(edges), "src int, dst int"), 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("within", [[], ["k"]])
def test_row_rank(spark, within):
    r = random.Random(5)
    rows = [(i, r.choice((None, 1, 1, 1, 2)), r.choice((None, 1.5, 2.5, 9.0))) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k int, v double").repartition(7)
    got = ranking.row_rank(df, "place", [F.asc_nulls_last("v"), F.desc("i")], within)
    assert got.columns == ["i", "k", "v", "place"]
    order = sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, -x[0]))
    seen, want = Counter(), {}
    for i, k, _ in order:
        seen[k if within else 0] += 1
        want[i] = seen[k if within else 0]
    assert {x["i"]: x["place"] for x in got.collect()} == want
