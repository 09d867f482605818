"""Intervals, lanes and joins against plain versions on small and random cases."""

import random

import pytest
from pyspark.sql import functions as F

from sagaframe.operators import intervals, lanes, matching


def spans(spark, rows):
    return spark.createDataFrame(rows, "k long, id long, a long, b long")


def some(seed, n=60):
    r = random.Random(seed)
    return [(r.randrange(3), i, a := r.randrange(50), a + r.randrange(12)) for i in range(n)]


def test_merge_gaps_and_adjacency(spark):
    rows = [(1, 1, 1, 3), (1, 2, 4, 5), (1, 3, 8, 9), (1, 4, 2, 2), (2, 5, 1, 1)]
    merged = intervals.merge(spans(spark, rows), ["k"])
    assert sorted(map(tuple, merged.collect())) == [(1, 1, 5, 3), (1, 8, 9, 1), (2, 1, 1, 1)]
    assert [tuple(r) for r in intervals.gaps(merged, ["k"]).collect()] == [(1, 6, 7)]
    assert intervals.merge(spans(spark, rows), ["k"], 3).where("k = 1").count() == 1
    assert intervals.merge(spans(spark, []), ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_concurrency_is_the_count_of_covering_spans(spark, seed):
    rows = some(seed)
    steps = {r["at"]: r["n"] for r in intervals.concurrency(spans(spark, rows), buckets=4).collect()}
    for at, n in steps.items():
        assert n == sum(a <= at <= b for _, _, a, b in rows)
    keyed = {(r["k"], r["at"]): r["n"] for r in intervals.concurrency(spans(spark, rows), ["k"]).collect()}
    for (k, at), n in keyed.items():
        assert n == sum(a <= at <= b for q, _, a, b in rows if q == k)


def test_cut_and_clip(spark):
    one = spans(spark, [(1, 1, 5, 9), (1, 2, 6, 6)])
    pieces = intervals.cut(one, F.array(F.lit(6), F.lit(9), F.lit(5), F.lit(20))).select("id", "pa", "pb").collect()
    assert sorted(map(tuple, pieces)) == [(1, 5, 5), (1, 6, 8), (1, 9, 9), (2, 6, 6)]
    right = spark.createDataFrame([(1, 7, 30), (1, 10, 12)], "k long, ra long, rb long")
    assert [tuple(r) for r in intervals.clip(one, right, ["k"]).select("id", "a2", "b2").collect()] == [(1, 7, 9)]


def test_label(spark):
    got = spark.createDataFrame([(1, 1), (1, 4)], "a int, b int").select(intervals.label_years(F.col("a"), F.col("b"), lambda c: c.cast("string")).alias("x")).collect()
    assert [r[0] for r in got] == ["1", "1–4"]


def packed(rows, touching):
    out = {}
    for k in {r[0] for r in rows}:
        ends = []
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], -r[3], r[1])):
            lane = next((n for n, e in enumerate(ends) if e < a or touching and e == a), len(ends))
            ends[lane : lane + 1] = [b]
            out[k, i] = lane
    return out


@pytest.mark.parametrize("hot", [19, 1000])
@pytest.mark.parametrize("touching", [True, False])
def test_pack(spark, touching, hot):
    """With 19 some keys are dealt by islands, others not."""
    rows = some(7)
    got = {(r["k"], r["id"]): r["lane"] for r in lanes.pack(spans(spark, rows), ["k"], touching, hot).collect()}
    assert got == packed(rows, touching)


@pytest.mark.parametrize("hot", [19, 1000])
def test_first_fit(spark, hot):
    rows = some(8)
    got = {(r["k"], r["id"]): r["lane"] for r in lanes.first_fit(spans(spark, rows).withColumn("p", F.col("id") % 5), ["k"], "p", hot).collect()}
    for k in range(3):
        placed = []
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] % 5, r[1])):
            taken = {n for n, a2, b2 in placed if b2 > a and a2 < b}
            lane = next(n for n in range(99) if n not in taken)
            assert got[k, i] == lane
            placed.append((lane, a, b))


def test_colour(spark):
    rows = some(9, 25)
    lanes_of = packed(rows, True)
    got = {(r["k"], r["id"]): r["slot"] for r in lanes.colour(lanes.pack(spans(spark, rows), ["k"]), ["k"], 4).collect()}
    for k in range(3):
        placed, last = [], {}
        for _, i, a, b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], -r[3], r[1])):
            lane = lanes_of[k, i]
            taken = {s for s, a2, b2 in placed if b2 >= a and a2 <= b} | ({last[lane]} if lane in last else set())
            slot = next((s for s in range(1, 5) if s not in taken), lane % 4 + 1)
            assert got[k, i] == slot
            placed.append((slot, a, b))
            last[lane] = slot


def test_cursor(spark):
    got = lanes.cursor(spans(spark, [(1, 1, 0, 4), (1, 2, 2, 3), (1, 3, 9, 9)]), ["k"]).orderBy("id").collect()
    assert [(r["start"], r["stop"]) for r in got] == [(0, 4), (4, 4.5), (9, 9.5)]
    missing = spark.createDataFrame([(1, 1, None, 4), (1, 2, 2, 3)], "k long, id long, a long, b long")
    assert [tuple(r) for r in lanes.pack(missing, ["k"]).orderBy("id").collect()] == [(1, 1, None, 4, None), (1, 2, 2, 3, 0)]
    assert lanes.first_fit(missing.withColumn("p", F.lit(1)).limit(0), ["k"], "p").collect() == []


def test_one_large_group(spark):
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") * 2).alias("a"), (F.col("id") * 2 + 5).alias("b"))
    assert [tuple(r) for r in lanes.pack(rows, ["k"]).groupBy("lane").count().orderBy("lane").collect()] == [(0, n // 3), (1, n // 3), (2, n // 3)]
    assert lanes.first_fit(rows.withColumn("p", F.col("id")), ["k"], "p").agg(F.max("lane"), F.count("*")).first()[:] == (2, n)
    assert lanes.cursor(rows, ["k"]).count() == n


@pytest.mark.parametrize("closed", [True, False])
def test_overlaps(spark, closed):
    left, right = some(3), some(4)
    r = spans(spark, right).select("k", F.col("id").alias("rid"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    got = sorted((x["id"], x["rid"]) for x in matching.overlaps(spans(spark, left), r, ["k"], 6, closed).collect())
    meet = (lambda a, b, c, d: c <= b and d >= a) if closed else (lambda a, b, c, d: c < b and d > a)
    assert got == sorted((i, j) for k, i, a, b in left for q, j, c, d in right if k == q and meet(a, b, c, d))


def test_near(spark):
    left, right = some(5), some(6)
    r = spans(spark, right).select("k", F.col("id").alias("rid"), F.col("a").alias("y"))
    got = sorted((x["id"], x["rid"]) for x in matching.near(spans(spark, left), r, "a", "y", ["k"], 3).collect())
    assert got == sorted((i, j) for k, i, a, _ in left for q, j, c, _ in right if k == q and abs(a - c) <= 3)


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([(1, 10, "x"), (1, 4, "y"), (2, 10, "z"), (1, 7, "w")], "k long, t long, name string")
    right = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (1, 9, 3), (1, 12, 4)], "k long, t long, v long")
    back = {r["name"]: r["v"] for r in matching.asof(left, right, ["k"], "t", ["v"]).collect()}
    assert back == {"x": 3, "y": None, "z": None, "w": 1}
    ahead = {r["name"]: r["v"] for r in matching.asof(left, right, ["k"], "t", ["v"], forward=True).collect()}
    assert ahead == {"x": 4, "y": 1, "z": None, "w": 2}
    close = {r["name"]: r["near_at"] for r in matching.nearest(left, right, ["k"], "t", ["v"]).collect()}
    assert close == {"x": 9, "y": 5, "z": None, "w": 5}


def test_containing_else_latest(spark):
    points = spark.createDataFrame([(1, 0), (1, 2), (1, 6), (1, 9), (2, 1)], "k long, t long")
    held = spark.createDataFrame([(1, 1, 3, "p"), (1, 8, 10, "q")], "k long, a long, b long, name string")
    got = {(r["k"], r["t"]): (r["inside"], r["name"]) for r in matching.containing_else_latest(points, held, ["k"], "t", ["name"]).collect()}
    assert got == {(1, 0): (None, "p"), (1, 2): (True, "p"), (1, 6): (False, "p"), (1, 9): (True, "q"), (2, 1): (None, None)}
