"""Quotations out of every member that holds some, and the check of their ledger."""

import re

import pytest

from sagaframe.functions import text as T
from sagaframe.plans import graph_rules, views
from sagaframe.sources import records as R

LONG, OTHER = "天下大亂之時也", "秋七月庚子朔日"
ROWS = [
    {"id": "a", "reigns": [{"note": f"「{LONG}」と「かな{LONG}」", "duration": {"source": {"quote": f"{LONG}（注）／短い/{OTHER}【註】", "conversion": f"「{OTHER}」"}}}, {"note": None}, {"note": f"「{OTHER}」「{LONG}」"}],
     "deathCause": {"note": f"「{LONG}」"}, "accessionRoute": {"note": "「短」"}, "ages": {"note": f"x「{OTHER}」"}, "amnestyCount": {"note": f"「{LONG}」", "events": [{"note": None}, {"note": f"「{OTHER}」"}]}},
    {"id": "b", "reigns": None, "rebellionSufferedCount": {"note": f"「・{LONG}」", "events": None}}, {"id": "c"},
]
HAN = f"[^{T.HAN}]"


def plain(rows):
    spoken = lambda s: [x for x in re.findall("「([^」]+)」", s or "") if not re.search("[ぁ-んァ-ヶ]", x) and len(re.sub(HAN, "", x)) >= 6]
    for e in rows:
        for i, r in enumerate(e.get("reigns") or []):
            s = (r.get("duration") or {}).get("source") or {}
            for j, part in enumerate(re.split("[／/]", s.get("quote") or "")):
                part = re.sub("（[^）]{0,30}）|【[^】]{0,30}】", "", part)
                if len(re.sub(HAN, "", part)) >= 6:
                    yield e["id"], f"reigns[{i}].quote#{j}", part
            yield from ((e["id"], f"reigns[{i}].conversion", x) for x in spoken(s.get("conversion")))
            yield from ((e["id"], f"reigns[{i}].note", x) for x in spoken(r.get("note")))
        for g in (*R.GROUPS, "deathCause", "accessionRoute", "ages"):
            yield from ((e["id"], f"{g}.note", x) for x in spoken((e.get(g) or {}).get("note")))
            for k, v in enumerate((e.get(g) or {}).get("events") or []):
                yield from ((e["id"], f"{g}[{k}].note", x) for x in spoken(v.get("note")))


@pytest.fixture(scope="module")
def units(spark, tmp_path_factory):
    import json

    path = tmp_path_factory.mktemp("records") / "r.json"
    path.write_text(json.dumps({"meta": {}, "records": ROWS}, ensure_ascii=False))
    return views.quotation_units(R.documents(spark, str(path))[1]).cache()


def test_units_of_all_paths(units):
    assert sorted((r["id"], r["path"], r["span"]) for r in units.collect()) == sorted(plain(ROWS))
    assert len(views.QUOTATIONS) == 22


def test_ledger_check(spark, units):
    keys = {r["path"]: r["key"] for r in units.collect() if r["id"] == "a"}
    state = {
        "reigns[0].quote#0": ("cache", "one", [LONG[:5], "不在"]), "reigns[0].quote#2": ("corpus", "one", ["不在"]), "reigns[0].conversion": ("corpus", "gone", [OTHER]), "reigns[0].note": ("cache", "one", []),
        "ages.note": ("defect", None, None), "deathCause.note": ("lacuna", None, None), "amnestyCount.note": ("unresolved", None, None), "amnestyCount[1].note": ("manual", None, None),
    }
    known = spark.createDataFrame([(keys[p], *x) for p, x in state.items()] + [("old|x|1", "manual", None, None)], "key string, status string, corpusFile string, frags array<string>")
    corpus = spark.createDataFrame([("one", "天、下大亂，之時也"), ("two", OTHER)], "path string, text string")
    names = {v: k for k, v in keys.items()}
    tell = lambda df: sorted((r["rule"], r["severity"], names.get(r["key"], r["key"].split("|")[0])) for r in df.collect())
    covered = [("defect", "warning", "ages.note"), ("lacuna", "warning", "deathCause.note"), ("stale", "warning", "old"), ("unregistered", "error", "b"), ("unregistered", "error", "reigns[2].note"), ("unregistered", "error", "reigns[2].note"), ("unresolved", "error", "amnestyCount.note")]
    got = tell(graph_rules.quotation_check(units, known))
    assert [x for x in got if x[0] != "unregistered"] == [x for x in covered if x[0] != "unregistered"] and sum(x[0] == "unregistered" for x in got) == 3
    full = tell(graph_rules.quotation_check(units, known, corpus))
    assert sorted(set(full) - set(got)) == [("lost", "error", "reigns[0].quote#2"), ("unreadable", "warning", "reigns[0].conversion")]
    assert {tuple(r) for r in graph_rules.status_counts(units, known).collect()} == {("cache", 2), ("corpus", 2), ("defect", 1), ("lacuna", 1), ("unresolved", 1), ("manual", 1)}
