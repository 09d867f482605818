"""Assertions inside plans, scopes of a graph, and lanes of islands and blocks."""

import pytest
from pyspark.sql import functions as F

from sagaframe.operators import asserting, intervals, lanes
from sagaframe.plans import views
from sagaframe.sources.records import EDGE, PERSON, RECORD
from test_intervals import packed, some, spans


def test_sized(spark):
    assert asserting.sized(spark.range(7), 7).count() == 7
    assert asserting.sized(spark.range(7).where("id > 9"), 0).count() == 0
    for rows in (spark.range(6), spark.range(7).where("id > 9")):
        with pytest.raises(Exception, match="nations, not 7"):
            asserting.sized(rows, 7, "nations").collect()


def test_unique(spark):
    rows = spark.createDataFrame([(1, None), (1, "a"), (2, "a")], "k int, v string")
    assert asserting.unique(rows, ["k", "v"]).count() == 3 and asserting.unique(rows.limit(0), ["k"]).count() == 0
    with pytest.raises(Exception, match="occurs 2 times"):
        asserting.unique(rows, ["k"]).collect()


def test_each_and_zipped(spark):
    rows = spark.createDataFrame([(1,), (None,)], "k int")
    assert asserting.each(rows, F.coalesce("k", F.lit(1)) > 0, F.lit("low")).count() == 2
    with pytest.raises(Exception, match="low"):
        asserting.each(rows, F.col("k") > 0, F.lit("low")).collect()
    pair = lambda n: asserting.zipped(F.array(F.lit("p"), F.lit("q")), F.sequence(F.lit(1), F.lit(n)), "rows")
    assert [tuple(x) for x in spark.range(1).select(pair(2)).first()[0]] == [("p", 1), ("q", 2)]
    with pytest.raises(Exception, match="rows: 3 for 2"):
        spark.range(1).select(pair(3)).collect()


def scope(spark, records, edges):
    reign = lambda a, b: {"startYear": a, "endYear": b, "isRestoration": False}
    made = [{"id": i, "name": {"commonName": i.upper()}, "dynasty": {"name": "D", "section": s}, "reigns": [reign(*r) for r in reigns]} for i, s, reigns in records]
    rows = spark.createDataFrame([(made,)], f"r array<{RECORD}>").select(F.inline("r"))
    people = spark.createDataFrame([([{"id": "p", "name": "P", "section": "in", "birthYear": -3}, {"id": "q", "name": "Q", "section": "out"}],)], f"p array<{PERSON}>").select(F.inline("p"))
    links = spark.createDataFrame([([{"type": t, "from": x, "to": y, "note": "n" * 200} for t, x, y in edges],)], f"e array<{EDGE}>").select(F.inline("e"))
    return views.graph_source(rows, people, links, ["in"], ["c"], 3)


def test_graph_source(spark):
    told = [("a", "in", [(-2, 5)]), ("b", "in", [(6, 9)]), ("c", "other", [(7, 8)]), ("d", "out", [(7, 8), (9, 9)])]
    held, people, edges = scope(spark, told, [("succession", "a", "b"), ("kinship", "p", "a"), ("succession", "b", "d"), ("marriage", "q", "a")])
    assert sorted((r["id"], r["a"], r["b"]) for r in held.collect()) == [("a", -1, 5), ("b", 6, 9), ("c", 7, 8)]
    assert [(r["id"], r["birthYear"]) for r in people.collect()] == [("p", -3)]
    assert sorted((r["type"], r["from"], r["to"], len(r["excerpt"])) for r in edges.collect()) == [("kinship", "p", "a", 161), ("succession", "a", "b", 161)]
    with pytest.raises(Exception, match="2 records in scope, not 3"):
        scope(spark, told[1:], [])[0].collect()
    for reigns in ([(1, 2), (4, 5)], [], [(1, None)]):
        with pytest.raises(Exception, match="not one reign of known years: b"):
            scope(spark, [told[0], ("b", "in", reigns), told[2]], [])[0].collect()
    with pytest.raises(Exception, match="no such type of edge: marriage"):
        scope(spark, told, [("marriage", "p", "a")])[2].collect()


@pytest.mark.parametrize("touching", [True, False])
def test_islands(spark, touching):
    """Buckets cut through islands and the islands stay whole; two that begin at one place share their name."""
    rows = some(11, 80) + [(3, 100 + i, 4, 4) for i in range(3)] + [(None, 200, 1, 9), (None, 201, 30, 31), (None, 202, 45, 46), (3, 203, None, 2), (3, 204, 6, None)]
    got = {r["id"]: r["at"] for r in intervals.islands(spans(spark, rows), ["k"], "at", touching, buckets=7).collect()}
    assert len(got) == len(rows)
    for k in {r[0] for r in rows}:
        reach = begun = None
        for _, i, a, b in sorted((r for r in rows if r[0] == k and r[2] is not None and r[3] is not None), key=lambda r: (r[2], -r[3])):
            if reach is None or a > reach or touching and a == reach:
                begun = a
            reach = b if reach is None else max(reach, b)
            assert got[i] == begun, (k, i)
    assert intervals.islands(spans(spark, []), ["k"], "at").count() == 0


def test_islands_of_one_key_go_over_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("k"), "id", (F.col("id") * 4).alias("a"), (F.col("id") * 4 + 5 * (F.col("id") % 2)).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = lanes.pack(rows, ["k"], hot=1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 8_000


@pytest.mark.parametrize("touching", [True, False])
def test_blocks(spark, touching):
    rows = some(12, 90)
    got = {(r["k"], r["id"]): (r["block"], r["lane"]) for r in lanes.pack_blocks(spans(spark, rows).withColumn("block", F.col("id") % 3), ["k"], "block", touching, hot=9).collect()}
    want = {}
    for k in range(3):
        before = 0
        for block in range(3):
            own = packed([r for r in rows if r[0] == k and r[1] % 3 == block], touching)
            want |= {key: (block, lane + before) for key, lane in own.items()}
            before += max(own.values(), default=-1) + 1
    assert got == want
