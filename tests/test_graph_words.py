"""The rules on edges in the words of the data format: one fixture row for each case."""

from pyspark.sql import functions as F

from sagaframe.operators import quality
from sagaframe.plans import graph_rules as G

EDGE = "type string, `from` string, `to` string, category string, isRestoration boolean, relation string, primaryLineage boolean, veracity string, source boolean, page string"


def succession(a, b, category="世襲", restored=False, veracity="verified"):
    return ("succession", a, b, category, restored, None, None, veracity, True, "漢書")


def kin(a, b, relation, veracity="verified", primary=None):
    return ("kinship", a, b, None, None, relation, primary, veracity, True, "漢書")


def tables(spark, edges, people=(("p-f", "female"), ("p-m", "male")), restored=(("e2", 1),)):
    n = dict(restored)
    ids = [("e1", "建国"), ("e2", "世襲"), ("e3", "復位"), ("e4", "世襲")]
    records = spark.createDataFrame([(i, (c,), [(k < n.get(i, 0),) for k in range(3)]) for i, c in ids], "id string, accessionRoute struct<category:string>, reigns array<struct<isRestoration:boolean>>")
    persons = spark.createDataFrame([(*p, None, None) for p in people], "id string, gender string, birthYear int, deathYear int")
    return persons, spark.createDataFrame(edges, EDGE), records


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_adoptive_parents_count(spark):
    _, edges, _ = tables(spark, [kin("e1", "e2", "養父"), kin("e2", "e1", "実母")])
    assert {k for k, _ in rows(G.cyclic(edges, G.FORMAT))} == {"e1", "e2"} and rows(G.cyclic(edges)) == []
    assert rows(G.descents(edges, G.FORMAT)) == [("e1", "e1 > e2 > e1")]


def test_genders_of_persons_only(spark):
    people, edges, _ = tables(spark, [kin("p-f", "e1", "養父"), kin("p-m", "e2", "養母"), kin("p-m", "e3", "実父"), kin("e4", "e3", "実母")])
    assert {k for k, _ in rows(G.genders(edges, people, G.FORMAT))} == {"p-f>kinship>e1", "p-m>kinship>e2"}


def test_repeats(spark):
    first, again = succession("e1", "e2"), succession("e1", "e2", "復位", True)
    fine = [first, again, succession("e1", "e2", veracity="disputed"), succession(None, "e2", "復位", True), succession(None, "e2", "復位", True), kin("e1", "e2", "実父"), kin("e1", "e2", "養父")]
    assert rows(G.repeated(tables(spark, fine)[1], G.FORMAT)) == []
    doubled = [kin("e1", "e2", "兄弟姉妹"), kin("e2", "e1", "兄弟姉妹"), succession("e1", "e4", veracity="disputed"), succession("e1", "e4", "簒奪", veracity="disputed")]
    assert {k for k, _ in rows(G.repeated(tables(spark, fine + doubled)[1], G.FORMAT))} == {"e1>kinship>兄弟姉妹>e2", "e1>succession>>e4>disputed"}


def test_limits(spark):
    _, edges, _ = tables(spark, [succession("e1", "e2"), succession("e3", "e2", veracity="disputed"), kin("p-m", "e2", "実父"), kin("e1", "e2", "養父"), kin("e1", "e4", "実父", primary=True), kin("p-f", "e4", "実母", primary=True), kin("p-m", "e4", "実父")])
    assert rows(G.limits(edges, G.FORMAT)) == [("e4", "2 father"), ("e4", "2 lineage")]


def test_routes_and_restorations(spark):
    _, edges, records = tables(spark, [succession("e1", "e2", "簒奪"), succession("e1", "e4", "簒奪", veracity="disputed"), succession("e1", "e3", "簒奪"), succession("e2", "e3", "復位"), succession("e1", "e2", "復位", True), succession("e3", "e2", "世襲", True), succession("e1", "e4", "復位", True)])
    assert {k for k, _ in rows(G.routes(edges, records, G.FORMAT))} == {"e1>succession>e2", "e2>succession>e3"}
    assert rows(G.restorations(edges, records)) == [("e2", "2 restorations for 1 restored reigns"), ("e3>succession>e2", "a restoration as 世襲"), ("e4", "1 restorations for 0 restored reigns")]


def test_siblings_by_an_adoptive_parent(spark):
    _, edges, _ = tables(spark, [kin("p-m", "e1", "養父"), kin("p-m", "e2", "実父"), kin("e2", "e1", "兄弟姉妹"), kin("e3", "e1", "兄弟姉妹")])
    assert [k for k, _ in rows(G.siblings(edges, G.FORMAT))] == ["e2>kinship>e1"]


def phases(spark, **status):
    return spark.createDataFrame(list(status.items()), "phase string, status string")


def test_coverage_by_phase(spark):
    _, edges, records = tables(spark, [succession("e1", "e2", veracity="disputed"), kin("e1", "e2", "養父")])
    listed = lambda *r: spark.createDataFrame(list(r), "id string, reason string")
    none = listed()
    assert rows(G.coverage(records, edges, phases(spark, succession="ongoing"), none, none)) == []
    assert [k for k, _ in rows(G.coverage(records, edges, phases(spark, succession="completed"), listed(("e3", "told so")), none))] == ["e4"]
    assert [k for k, _ in rows(G.coverage(records, edges, phases(spark, succession="ongoing", parentage="completed"), none, listed(("e1", "unknown"))))] == ["e3", "e4"]
    odd = listed(("e2", "told so"), ("zz", "told so"), ("e3", ""), ("e4", "a"), ("e4", "b"))
    assert rows(G.coverage(records, edges, phases(spark, x="completed"), odd, none)) == [("e2", "listed for succession, but stale"), ("e3", "listed for succession without a reason"), ("e4", "occurs 2 times"), ("zz", "listed for succession, but no record")]


def test_suite_holds_every_rule(spark):
    people, edges, records = tables(spark, [succession("e1", "e2", "世襲"), (*succession("e2", "e4")[:-1], "a wiki")])
    told = spark.createDataFrame([("zz", "a king", True, "漢書")], "claimant string, claimedAncestry string, source boolean, page string")
    none = spark.createDataFrame([], "id string, reason string")
    found = quality.suite(G.rules(people, edges, records, complete=False, words=G.FORMAT, told=told, recognised=F.col("page").contains("書"), documents=spark.createDataFrame([("g", '{"meta": {}}')], "path string, text string"), gated=(phases(spark, succession="completed"), none, none)))
    kinds = {(r["rule"], r["key"]) for r in found.collect()}
    assert kinds >= {("claims", "zz"), ("sources", "e2>succession>e4"), ("structure", "g"), ("phases", "e3")}
    assert not {k for k in kinds if k[0] in ("repeated", "limits", "cycles", "descents", "routes", "restorations")}
