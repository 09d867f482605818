"""Ranks, aggregates, integrity, rules and graphs on small cases with ties, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from sagaframe.operators import aggregates, graph, matching, quality, ranking


def test_rank_ties_nulls_and_eligibility(spark):
    df = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None), ("e", 0)], "n string, v int")
    got = {r["n"]: (r["rank"], r["total"], r["tied"]) for r in ranking.competition_rank(df, "v", eligible=F.col("v") > 0).collect()}
    assert got == {"a": (1, 3, True), "b": (1, 3, True), "c": (3, 3, False), "d": (None, None, None), "e": (None, None, None)}
    assert ranking.competition_rank(df.where("v > 9"), "v").count() == 0
    assert {r["n"] for r in ranking.leaders(ranking.competition_rank(df, "v")).collect()} == {"a", "b"}


def test_rank_over_many_buckets(spark):
    df = spark.range(500).select((F.col("id") % 97).alias("v"))
    got = {r["v"]: r["rank"] for r in ranking.competition_rank(df, "v", buckets=8).distinct().collect()}
    values = sorted((i % 97 for i in range(500)), reverse=True)
    assert got == {v: values.index(v) + 1 for v in set(values)}


def test_page_and_viewport(spark):
    assert ranking.viewport(2400, 480, 1500) == (88, 136)
    assert ranking.viewport(0, 480, 20) == (0, 20)
    assert [r["id"] for r in ranking.page(spark.range(10), 3, 6, F.desc("id")).collect()] == [6, 5, 4]


def test_profile_first_wins(spark):
    df = spark.createDataFrame([("g", 3.0, "x", 2, "p"), ("g", 3.0, "y", 1, "q"), ("h", 1.0, "z", 3, "p")], "k string, v double, name string, ord int, c string")
    got = {r["k"]: r.asDict() for r in aggregates.group_profile(df, "k", "v", "name", "ord", "c", ["p", "q", "r"]).collect()}
    assert got["g"]["longest"] == "y" and [got["g"][f"n_{i}"] for i in range(3)] == [1, 1, 0]
    whole = aggregates.overview(df, "v", "name", "ord", "c").first()
    assert (whole["n"], whole["largest"], whole["least"], whole["mode"], whole["mode_n"], whole["mode_percent"]) == (3, "y", "z", "p", 2, 67)


def test_percent_and_half_up(spark):
    got = spark.createDataFrame([(1.0, 8.0), (0.0, 0.0)], "a double, b double").select(aggregates.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r[0] for r in got] == [13, 0]
    assert spark.range(1).select(aggregates.half_up(F.lit(-2.5))).first()[0] == -2


def test_runs_keep_null_states_apart(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, t int, s string")
    got = aggregates.runs(df, ["k"], ["t"], "s").orderBy("run").collect()
    assert [(r["s"], r["first"], r["last"], r["n"]) for r in got] == [("a", 1, 2, 2), (None, 3, 4, 2), ("a", 5, 5, 1)]


def test_last_wins_and_reconcile(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    assert {r["k"]: r["v"] for r in aggregates.last_wins(a, b, key="k", value="v").collect()} == {1: "x", 2: "z"}
    stored = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 0.0)], "k int, t double")
    parts = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "k int, p double")
    assert [(r["k"], r["recomputed"]) for r in aggregates.reconcile(stored, parts, "k", "t", "p", 0.01).collect()] == [(2, 4.0)]


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (1, "p")], "k int, w string")
    assert {r["v"] for r in matching.orphans(a, b, ["k"]).collect()} == {"y", "z"}
    assert {r["v"]: r["there"] for r in matching.existence_flag(a, b, "k", "there").collect()} == {"x": True, "y": False, "z": False}
    with pytest.raises(Exception, match="no w for k 2"):
        matching.strict_lookup(a.where("k = 2"), b, "k", "w").collect()
    got = {r["k"]: r["status"] for r in matching.coverage(b.select("k"), a.where("k IS NOT NULL").select("k"), "k").collect()}
    assert got == {1: "repeated", 2: "missing"}


def test_filters_and_ledgers(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("a", None)], "g string, v int")
    assert matching.optional_filters(df, g="all").count() == 3 and matching.optional_filters(df, g="a").count() == 2
    kept, left = matching.ranked_filter(df, "v", True)
    assert kept.count() == 1 and tuple(left.first()) == (1, 1)
    now = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    known = spark.createDataFrame([(2, "cache"), (3, "unresolved"), (4, "cache")], "key int, status string")
    assert {r["key"]: (r["status"], r["state"]) for r in matching.ledger(now, known, "key").collect()} == {1: ("pending", "new"), 2: ("cache", "known"), 3: ("unresolved", "retry"), 4: ("cache", "stale")}
    merged = matching.upsert(known, spark.createDataFrame([(2, "corpus"), (9, None)], "key int, status string"), "key", ["status"])
    assert {r["key"]: r["status"] for r in merged.collect()} == {2: "corpus", 3: "unresolved", 4: "cache", 9: None}


def test_rule_suite(spark):
    df = spark.createDataFrame([("a", "ok", ["x"]), ("a", "bad", ["y"]), ("b", None, [])], "k string, s string, l array<string>")
    rules = [
        quality.Rule("unique", "error", lambda: quality.unique(df, "k"), ("a", "gone")),
        quality.Rule("format", "error", lambda: quality.matches(df, "k", "s", "^ok$")),
        quality.Rule("words", "warning", lambda: quality.vocabulary(df, "k", "s", ["ok"])),
        quality.Rule("subset", "warning", lambda: quality.subset(df, "k", "l", ["x"])),
    ]
    found = quality.suite(rules)
    assert {(r["rule"], r["severity"]): r["n"] for r in quality.summary(found).collect()} == {("unique", "warning"): 1, ("format", "error"): 2, ("words", "warning"): 1, ("subset", "warning"): 1}
    assert not quality.passed(found) and quality.passed(found.where("rule = 'words'")) and quality.first_reports(found, 2).count() == 2


def test_json_members(spark):
    raw = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "z": null}')], "id int, j string")
    assert [r["detail"] for r in quality.unknown_fields(raw, "j", "id", ["a"]).collect()] == ["unknown key z"]
    paths = {r["path"] for r in quality.walk(raw, F.parse_json("j"), "id", 4).collect()}
    assert {"/a", "/a/b", "/a/b/[0]", "/a/b/[1]/c", "/z"} <= paths


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def test_graph_basics(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 3), (1, 3)])
    v = spark.range(1, 6)
    assert {r["id"] for r in graph.roots(v, e).collect()} == {4, 5}
    assert {tuple(r) for r in graph.undirected(e).collect()} == {(1, 2, 2), (2, 3, 1), (3, 3, 1), (1, 3, 1)}
    assert {r["id"] for r in graph.neighbours(e, 3).collect()} == {1, 2}
    assert {tuple(r) for r in graph.common_parents(e).collect()} == {(1, 3, 1), (2, 3, 1)}
    assert [tuple(r) for r in graph.cardinality(e.withColumn("kind", F.lit("k")), {"k": 2}).collect()] == [(3, "k", 3, 2)]


def test_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 7)])
    assert {tuple(r) for r in graph.cycles(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7)}
    assert graph.cycles(edges(spark, [(1, 2), (2, 3)])).count() == 0
    assert {r["id"] for r in graph.acyclic_violations(edges(spark, [(1, 2), (2, 1), (2, 3), (0, 1)])).collect()} == {1, 2}
    assert graph.acyclic_violations(edges(spark, [])).count() == 0


def test_relaxation(spark):
    v = spark.createDataFrame([(1, 0.0), (2, None), (3, None), (4, 9.0)], "id long, value double")
    got = {r["id"]: r["value"] for r in graph.relax(v, edges(spark, [(1, 2), (2, 3), (3, 4)])).collect()}
    assert got[1] == 0 and got[4] == 9 and abs(got[2] - 3) < 1e-4 and abs(got[3] - 6) < 1e-4
    with pytest.raises(ValueError, match="reached by no known value"):
        graph.relax(spark.createDataFrame([(1, None)], "id long, value double"), edges(spark, []))


def test_walk_raises_below_its_depth(spark):
    raw = spark.createDataFrame([(1, '{"a": {"b": {"c": 1}}, "e": [], "f": {}}')], "id long, j string")
    assert {r["path"] for r in quality.walk(raw, F.parse_json("j"), "id", 3).collect()} == {"/a", "/a/b", "/a/b/c", "/e", "/f"}
    with pytest.raises(Exception, match="members below level 2"):
        quality.walk(raw, F.parse_json("j"), "id", 2).collect()


def test_distribution_keeps_unlisted_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "c string")
    assert sorted((r["c"], r["n"], r["pos"]) for r in aggregates.distribution(df, "c", ["b", "a"]).collect()) == [("a", 1, 1), ("b", 1, 0), ("z", 2, 2)]
