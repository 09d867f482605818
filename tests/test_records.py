"""Views and rule suites on a small hand-written set of nested records and a graph."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from sagaframe.operators import quality
from sagaframe.plans import graph_rules, record_rules, views
from sagaframe.sources import records as R


def reign(a, b, start=None, end=None, precision=(None, None), days=None, exact=None, restored=False, note=None):
    return {
        "startYear": a, "endYear": b, "startDate": start, "endDate": end, "datePrecision": {"start": precision[0], "end": precision[1]}, "isRestoration": restored, "note": note,
        "duration": {"approxDays": days, "exactDays": exact, "needsPreciseDays": exact is None},
    }


def record(id, common, section, reigns, group="Han", **more):
    total = sum(r["duration"]["approxDays"] for r in reigns)
    exact = all(r["duration"]["exactDays"] is not None for r in reigns)
    return {
        "id": id, "name": {"commonName": common, "personalName": f"{common} I（x）", "aliases": ["nick"]}, "dynasty": {"name": group, "category": "main", "section": section}, "reigns": reigns,
        "reignSummary": {"firstStartYear": reigns[0]["startYear"], "lastEndYear": reigns[-1]["endYear"], "reignCount": len(reigns), "totalReignDuration": {"approxDays": total, "isExact": exact, "exactDays": sum(r["duration"]["exactDays"] for r in reigns) if exact else None, "displayYears": round(total / 365, 1)}},
        "sources": {"wikidata": f"Q{abs(hash(id)) % 1000 + 1}{len(id)}"}, "verification": {"confidence": "high"},
    } | more


SOURCE = {"page": "good book", "lang": "zh", "note": "", "quote": ""}
BASE = [
    record("a-one", "A", "West", [reign(-2, -1, days=400), reign(3, 5, "0003-01-01", "0005-01-01", ("day", "day"), 731, 731, True, "back")],
           eraChangeCount={"count": 2, "note": "twice", "events": [{"date": "0004-05", "datePrecision": "month", "name": "N", "source": SOURCE}, {"startDate": "0003", "endDate": "0004-02", "datePrecision": {"start": "year", "end": "month"}}]},
           deathCause={"category": "illness", "note": "First. Second。rest", "source": SOURCE}, accessionRoute={"category": "heir", "note": ""}, ages={"birthDate": "-0020-03", "birthDatePrecision": "month", "deathDate": "0006-01-01", "deathDatePrecision": "lunar-day", "deathAge": 27}),
    record("b-two", "B", "East", [reign(5, 9, days=1500)], amnestyCount={"count": 0, "events": []}, rebellionSufferedCount={"count": 1, "events": [{"date": "no date"}]}),
    record("c-three", "C", "East", [reign(12, 12, days=100)], "Wei", flags={"usedEmperorTitleFrom": 11}),
]


@pytest.fixture()
def load(spark, tmp_path):
    def made(rows, name="d"):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps({"meta": {"count": len(BASE)}, "records": rows}))
        return R.documents(spark, str(path))

    return made


def test_wide_and_light(load):
    _, rows = load(BASE)
    flat = {r["id"]: r for r in views.with_ranks(views.wide(rows), ("days", "n_eraChangeCount")).collect()}
    a, b, c = flat["a-one"], flat["b-two"], flat["c-three"]
    assert (a["title"], a["key"], a["periods"], a["days"], a["n_eraChangeCount"], a["death_cause"]) == ("A", "Han__West", "前2–前1年 / 3–5年", 1131, 2, "illness")
    assert (b["n_amnestyCount"], b["death_cause"], b["rank_days"], b["rank_n_eraChangeCount"], c["total_days"]) == (0, "不詳", 1, None, 3)
    assert {r["id"] for r in views.light(views.wide(rows)).collect()} == set(flat)
    with pytest.raises(Exception, match="no search text"):
        views.light(views.wide(rows).withColumn("search_text", F.lit(""))).collect()
    assert [r["id"] for r in views.restorations(views.wide(rows)).collect()] == ["a-one"]
    assert {r["key"]: r["label"] for r in views.labels(rows, {"West": "W"}).collect()} == {"Han__West": "Han（W）", "Han__East": "Han（East）", "Wei__East": "Wei"}
    assert views.peers(views.wide(rows), 1).count() == 3 and views.peers(views.wide(rows)).count() == 0


def test_narratives_dates_events(load):
    _, rows = load(BASE)
    told = {r["id"]: r for r in views.narratives(rows).collect()}
    assert told["a-one"]["death"]["lead"] == "First. Second。" and told["a-one"]["accession"] is None and told["b-two"]["death"] is None
    assert [(x["period"], x["note"]) for x in told["a-one"]["restorations"]] == [("3–5年", "back")] and told["a-one"]["memos"][0]["note"] == "twice"
    assert {r["id"]: (r["birth"], r["death"]) for r in views.structured_dates(rows).collect()}["a-one"] == ("-0020-03", "0006-01-01")
    got = [(r["label"], r["end_label"], r["sort_key"], [x["value"] for x in r["facts"]]) for r in views.event_rows(rows).where("id = 'a-one'").orderBy(*views.event_order()).collect()]
    assert got == [("0003", "0004-02", 30000, []), ("0004-05", None, 40500, ["N"])]
    assert [(r["label"], r["sort_key"]) for r in views.event_rows(rows).where("id = 'b-two'").collect()] == [("no date", None)]
    assert {(r["id"], r["kind"], r["n"]) for r in views.event_facets(rows).collect()} == {("a-one", "eraChangeCount", 2), ("b-two", "rebellionSufferedCount", 1)}


def test_timelines(spark, load):
    _, rows = load(BASE)
    assert views.bounds(rows) == (-2, 12)
    found = {r["key"]: r for r in views.bands(rows, ["main"]).collect()}
    assert (found["Han__West"]["a"], found["Han__West"]["b"], found["Han__West"]["n_spans"], found["Han__West"]["category"]) == (-1, 5, 2, "main")
    assert {r["key"]: r["lane"] for r in views.laned_bands(views.bands(rows, ["main"])).collect()} == {"Han__West": 0, "Han__East": 0, "Wei__East": 0}
    assert {tuple(r) for r in views.vacancies(rows, {(1, 2): "first"}).collect()} == {(1, 2, "first"), (10, 11, "空位")}
    assert [(r["state"], r["first"], r["last"]) for r in views.states(rows, 10).orderBy("first").collect()] == [("sole", -1, 0), ("vacant", 1, 2), ("sole", 3, 4), ("split", 5, 5), ("sole", 6, 9), ("vacant", 10, 11), ("split", 12, 12)]
    mapping = spark.createDataFrame([("Han__West", "x"), ("Han__East", "x"), ("Wei__East", "y")], "key string, stream string")
    assert sorted((r["stream"], r["pa"], r["pb"]) for r in views.streams(rows, mapping, [7]).collect()) == [("x", -1, 0), ("x", 3, 6), ("x", 7, 9), ("y", 12, 12)]
    assert sorted((r["stream"], r["first"], r["last"]) for r in views.sole_pieces(rows, mapping).collect()) == [("x", -1, 0), ("x", 3, 9), ("y", 12, 12)]
    with pytest.raises(ValueError, match="don't match"):
        views.streams(rows, mapping.limit(1))
    assert {r["section"]: (r["a"], r["b"], r["n"]) for r in views.eras(rows).collect()} == {"West": (-1, 5, 1), "East": (5, 12, 2)}
    assert len(views.flat_csv(rows).columns) == 41 and views.flat_csv(rows).where("id = 'c-three' AND amnestyCount IS NULL").count() == 1


SETTINGS = record_rules.Settings(forbidden=("wiki",), coexistence=("together",))


def broken(load, change, name, only=None):
    rows = copy.deepcopy(BASE)
    change(rows)
    meta, df = load(rows, name)
    found = quality.suite([r for r in record_rules.rules(df, meta, SETTINGS) if only in (None, r.name)])
    return {(r["rule"], r["key"]) for r in found.collect()}


def test_clean_records_pass(load):
    assert broken(load, lambda r: None, "clean") == {("event dates", "b-two#rebellionSufferedCount#0")}


CHANGES = {
    "id": (lambda r: r[1].update(id="B 2"), ("id", "B 2")), "repeat": (lambda r: r.append(r[2]), ("id unique", "c-three")), "count": (lambda r: r.pop(), ("count", "meta")),
    "name": (lambda r: r[1]["name"].update(commonName=" "), ("name", "b-two")), "item": (lambda r: r[1]["sources"].update(wikidata="Q0"), ("item", "b-two")),
    "order": (lambda r: r[0]["reigns"][1].update(endDate="0002-01-01"), ("reign dates", "a-one#1")), "precision": (lambda r: r[0]["reigns"][1].update(startDate="0003-01"), ("reign dates", "a-one#1")),
    "no length": (lambda r: r[2]["reigns"][0]["duration"].update(approxDays=None), ("reign dates", "c-three#0")), "group": (lambda r: r[0]["eraChangeCount"].update(count=3), ("counts", "a-one")),
    "event year": (lambda r: r[0]["eraChangeCount"]["events"][0].update(date="0014"), ("event years", "a-one#eraChangeCount#0")), "bce": (lambda r: r[0]["eraChangeCount"]["events"][0].update(date="-0005", note="前2年"), ("bce years", "a-one#eraChangeCount#0")),
    "age": (lambda r: r[0]["ages"].update(deathAge=40), ("ages", "a-one")), "born late": (lambda r: r[0]["ages"].update(birthDate="0007-01"), ("ages", "a-one")),
    "null note": (lambda r: r[0]["ages"].update(note="deathAge stays null"), ("null notes", "a-one")), "title": (lambda r: r[2]["flags"].update(usedEmperorTitleFrom=9), ("title year", "c-three")),
    "summary": (lambda r: r[0]["reignSummary"].update(reignCount=9), ("summary", "a-one")), "years": (lambda r: r[1]["reignSummary"]["totalReignDuration"].update(displayYears=9.9), ("summary", "b-two")),
    "word": (lambda r: r[0]["verification"].update(confidence="sure"), ("vocabulary", "a-one")), "source": (lambda r: r[0]["deathCause"]["source"].update(page="wiki x"), ("sources", "a-one")),
    "shape": (lambda r: r[0]["eraChangeCount"]["events"][1]["datePrecision"].update(middle="day"), ("event dates", "a-one#eraChangeCount#1")),
    "overlap": (lambda r: (r[0]["reigns"][1].update(endDate="0006-01-01", endYear=6), r[1]["reigns"][0].update(startDate="0005-06-01", datePrecision={"start": "day", "end": None})), ("overlaps", "a-one#1")),
}


@pytest.mark.parametrize("name", sorted(CHANGES))
def test_each_rule_finds_its_violation(load, name):
    change, want = CHANGES[name]
    assert want in broken(load, change, "broken", want[0])


def test_stale_exceptions(load):
    meta, df = load(BASE)
    settings = record_rules.Settings(allowed={"event dates": ("b-two#rebellionSufferedCount#0",), "name": ("z",)})
    assert [(r["rule"], r["severity"], r["key"]) for r in quality.suite(record_rules.rules(df, meta, settings)).collect()] == [("name", "warning", "z")]


def test_portraits(spark):
    manifest = spark.createDataFrame([("a", "a.webp"), ("a", "a.webp"), ("z", "lost.webp")], "id string, localFile string")
    files = spark.createDataFrame([("a.webp", "1"), ("more.webp", "1")], "name string, md5 string")
    got = {tuple(r) for r in record_rules.portraits(manifest, files, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", "listed twice"), ("z", "no such record"), ("lost.webp", "no such file"), ("more.webp", "not listed"), ("a.webp", "equal to another"), ("more.webp", "equal to another")}


EDGE = "type string, `from` string, `to` string, category string, isRestoration boolean, relation string, primaryLineage boolean, veracity string"
GOOD = [("succession", "a-one", "b-two", None, None, None, None, None), ("kinship", "p-x", "a-one", None, None, "father", True, "verified"), ("kinship", "p-x", "b-two", None, None, "father", None, "verified"), ("marriage", "p-x", "p-y", None, None, None, None, None), ("succession", None, "a-one", "heir", True, None, None, None)]


def graph_found(spark, rows, edges, **kw):
    people = spark.createDataFrame([("p-x", "male", 1, 9), ("p-y", "female", None, None)] + kw.pop("people", []), "id string, gender string, birthYear int, deathYear int")
    found = quality.suite(graph_rules.rules(people, spark.createDataFrame(edges, EDGE), rows, ("c-three",), **kw))
    return {(r["rule"], r["key"]) for r in found.collect()}


def test_graph_rules(spark, load):
    _, rows = load(BASE)
    assert graph_found(spark, rows, GOOD) == set()
    more = [
        ("kinship", "b-two", "p-x", None, None, "father", None, "verified"), ("marriage", "p-y", "p-x", None, None, None, None, None), ("kinship", "p-y", "b-two", None, None, "father", None, "verified"),
        ("kinship", "a-one", "b-two", None, None, "sibling", None, None), ("kinship", "q", "c-three", None, None, "uncle", None, None), ("succession", "b-two", "a-one", "coup", None, None, None, None), ("kinship", "p-y", "p-y", None, None, "aunt", None, None),
    ]
    found = graph_found(spark, rows, GOOD + more, people=[("p-z", None, 5, 1), ("a-one", None, None, None)])
    assert found >= {("ends", "q>kinship>c-three"), ("ends", "p-y>kinship>p-y"), ("repeated", "p-x>marriage>>p-y"), ("limits", "b-two"), ("cycles", "p-x"), ("cycles", "b-two"), ("genders", "p-y>kinship>b-two"), ("siblings", "a-one>kinship>b-two"), ("routes", "b-two>succession>a-one"), ("persons", "p-z"), ("persons", "a-one"), ("orphans", "p-z"), ("coverage", "c-three")}
    assert ("coverage", "c-three") not in graph_found(spark, rows, GOOD + more, complete=False)


def test_calendar_claims(spark):
    claims = spark.createDataFrame([("a", "x→0618-06-18"), ("b", "→0700-01-01")], "id string, note string")
    stored = spark.createDataFrame([("a", "0618-06-20"), ("a", "0618-06-17"), ("b", "0701-01-01"), ("b", "0700")], "id string, date string")
    assert [(r["id"], r["claim"], r["off"]) for r in graph_rules.calendar_claims(claims, stored).collect()] == [("a", "0618-06-18", 1)]


def test_quotation_ledger(spark):
    units = spark.createDataFrame([("k1", "the quick brown fox"), ("k2", "kept as it is"), ("k3", "nobody has written this"), ("k4", "jumps over the lazy dog")], "key string, span string")
    known = spark.createDataFrame([("k2", "manual"), ("k4", "unresolved"), ("gone", "cache")], "key string, status string")
    corpus = spark.createDataFrame([(1, "a quick brown fox jumps over the lazy dog"), (2, "the quick brown fox")], "doc_id int, text string")
    got = {r["key"]: (r["status"], r["doc_id"]) for r in graph_rules.quotations(units, known, corpus).collect()}
    assert got == {"k1": ("whole", 2), "k2": ("manual", None), "k3": ("unresolved", None), "k4": ("whole", 1)}


def test_graph_sources_claims_and_structure(spark):
    listed = F.col("page").contains("書")
    rows = spark.createDataFrame([("a", True, "漢書"), ("b", True, ""), ("c", True, "a wiki"), ("d", None, None), ("e", True, None)], "key string, source boolean, page string")
    got = {tuple(r) for r in graph_rules.sources(rows, listed).collect()}
    assert got == {("b", "the source names no page"), ("e", "the source names no page"), ("c", "a source that isn't recognised"), ("d", "no source")}
    assert {r["key"] for r in graph_rules.sources(rows, listed, required=False).collect()} == {"b", "c", "e"}
    told = spark.createDataFrame([("x", "a king", True, "漢書"), ("y", "", True, "漢書"), (None, "a king", None, None)], "claimant string, claimedAncestry string, source boolean, page string")
    known = spark.createDataFrame([("x",), ("y",)], "id string")
    assert sorted(tuple(r) for r in graph_rules.claims(told, known, listed).collect()) == [("-", "no source"), ("-", "nobody's claim"), ("y", "claims nothing")]
    texts = [("whole", '{"meta": {"status": {"phases": {"succession": 1, "parentage": 1, "interdynastic": 1, "crosscheck": 1}}}, "persons": [], "edges": [], "genealogicalClaims": []}'), ("part", '{"meta": {}, "persons": [], "edges": []}'), ("none", None)]
    lacks = graph_rules.structure(spark.createDataFrame(texts, "path string, text string")).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in lacks} == {"part": 5, "none": 8}
