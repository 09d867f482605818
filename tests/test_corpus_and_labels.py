"""The corpus source with its pushed filters and keyed reads; neighbours between rows; labels, orders and lists."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual, StringContains

from sagaframe.functions import dates as D
from sagaframe.functions import text as T
from sagaframe.operators import aggregates, matching
from sagaframe.plans import graph_rules, views
from sagaframe.sources import corpus
from sagaframe.sources.records import RECORD


def folder(tmp_path):
    for name, text in {"x/第九章-a.txt": "nine", "x/第十章-b.txt": "ten", "x/第二十三章-c.txt": "three", "y/notes.txt": "", "y/other.bin": "b"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_files(spark, tmp_path):
    roots = [folder(tmp_path), str(tmp_path / "none")]
    got = {r["path"]: (r["root"], r["n"], r["text"]) for r in corpus.files(spark, roots, ".txt").collect()}
    assert got == {"x/第九章-a.txt": (roots[0], 9, "nine"), "x/第十章-b.txt": (roots[0], 10, "ten"), "x/第二十三章-c.txt": (roots[0], 23, "three"), "y/notes.txt": (roots[0], None, "")}
    assert corpus.chapter_range(corpus.files(spark, roots, ".txt"), 9, 10).first()["text"] == "nine\n\nten"
    assert corpus.files(spark, roots[1:]).count() == 0 and corpus.files(spark, roots, ".txt").where("n IS NULL").count() == 1
    assert [r["text"] for r in corpus.files(spark, roots).where("path = 'y/other.bin' AND text LIKE 'b%'").collect()] == ["b"]


def test_only_chosen_files_are_opened(tmp_path):
    reader = corpus._Reader({"roots": json.dumps([folder(tmp_path)])})
    rest = list(reader.pushFilters([GreaterThanOrEqual(("n",), 10), LessThanOrEqual(("n",), 22), EqualTo(("text",), "t"), StringContains(("path",), "x")]))
    assert [f for part in reader.partitions() for f in part.files] == [(str(tmp_path), "x/第十章-b.txt", 10)] and len(rest) == 2
    reader = corpus._Reader({"roots": json.dumps([str(tmp_path)]), "bytes": "5"})
    assert [len(part.files) for part in reader.partitions()] == [1, 1, 3]


def test_filters_reach_the_source(spark, tmp_path):
    """What the source has taken over is no longer compared behind the scan."""
    plan = corpus.files(spark, [folder(tmp_path)]).where("path = 'y/notes.txt' AND text = 't'")._jdf.queryExecution().executedPlan().toString()
    assert "= y/notes.txt" not in plan and "= t)" in plan


def test_keyed_reads(spark, tmp_path):
    root = folder(tmp_path)
    asked = spark.createDataFrame([("x/第九章-a.txt",), ("x/第九章-a.txt",), ("gone",), ("",), (None,)], "path string")
    assert sorted((r["path"] or "", r["text"]) for r in corpus.keyed(asked, [str(tmp_path / "none"), root]).collect()) == [("", ""), ("", ""), ("gone", ""), ("x/第九章-a.txt", "nine")]


def test_rules_of_absent_roots_are_left_out(spark, tmp_path):
    (tmp_path / "f.txt").write_text("天地玄黄宇宙洪荒")
    units = spark.createDataFrame([("k1", "天地玄黄"), ("k2", "日月盈昃"), ("k3", "辰宿列張")], "key string, span string")
    known = spark.createDataFrame([("k1", "corpus", "f.txt", ["天地玄黄"]), ("k2", "corpus", "f.txt", ["日月盈昃"]), ("k3", "corpus", "gone.txt", ["辰宿列張"])], "key string, status string, corpusFile string, frags array<string>")
    check = lambda roots: sorted((r["rule"], r["key"]) for r in graph_rules.quotation_check(units, known, graph_rules.rooted(roots)).collect())
    assert check([str(tmp_path)]) == [("lost", "k2"), ("unreadable", "k3")]
    assert check([str(tmp_path / "none")]) == [] and graph_rules.rooted([]) is None


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_neighbours_between_rows(spark, seed, forward):
    r = random.Random(seed)
    rows = [(i, r.randrange(4), f"g{r.randrange(3)}", a := r.randrange(60), a + r.randrange(9)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, row long, g string, a long, b long")
    got = {x["id"]: (x["distance"], x["near_group"]) for x in matching.next_in_row(df, "row", "g", forward).collect()}
    gap = (lambda x, y: y[3] - x[4]) if forward else (lambda x, y: x[3] - y[4])
    for x in rows:
        far = [(gap(x, y), y[2]) for y in rows if y[1] == x[1] and y[2] != x[2] and gap(x, y) > 0]
        least = min((d for d, _ in far), default=None)
        assert got[x[0]][0] == least, x
        assert least is None or (least, got[x[0]][1]) in far
    points = spark.createDataFrame([(i, r.randrange(70), r.randrange(4)) for i in range(30)], "id long, t long, row long")
    found = matching.parallel_row(points, df.select("a", "b", "row", "g"), "t", "row", ["g"], 8, forward).collect()
    assert len(found) == 30
    for p in found:
        held = [(abs(y[1] - p["row"]), y[3], y[2], y[1]) for y in rows if y[3] <= p["t"] <= y[4] + 1 and (y[1] > p["row"] if forward else y[1] < p["row"])]
        want = min(held)[1:] if held else (None, None, None)
        assert (p["near_a"], p["near_g"], p["near_row"]) == want


def test_lists_orders_and_parameters(spark):
    left, right = spark.range(2), spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "id long, pos int, v string")
    assert sorted(tuple(r) for r in matching.with_lists(left, right, "id", "pos", "v", "vs").collect()) == [(0, ["a", "b"]), (1, [])]
    assert [r[0] for r in right.select(aggregates.place(F.col("v"), ["b", "a"])).collect()] == [0, 1]
    with pytest.raises(Exception, match="not in the order: b"):
        right.select(aggregates.place(F.col("v"), ["a"])).collect()
    hits = spark.createDataFrame([("reigns[0].note", "y"), ("reigns[1].note", "x"), ("ages", "z")], "field string, id string")
    assert sorted((r["field"], [h["id"] for h in r["hits"]]) for r in aggregates.by_field(hits, "field", "id").collect()) == [("ages", ["z"]), ("reigns", ["x", "y"])]
    assert matching.restored({"q": "?", "kind": "a", "page": "9"}, {"kind": ["a", "b"], "page": ["1"]}) == {"kind": "a"}


def test_labels(spark):
    one = lambda *cs: spark.range(1).select(*cs).first()[:]
    assert one(*(T.context_label(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in [("明", "明", "明清"), ("呉", "呉", "三国"), ("呉（三国）", "呉", "三国")])) == ("明", "呉（三国）", "呉（三国）")
    assert one(T.age_text(F.lit(3)), T.age_text(F.lit(None).cast("int"))) == ("3歳（数え年）", "不詳")
    assert one(T.rank_text(F.lit(3), F.lit(364), F.lit(False)), T.rank_text(F.lit(5), F.lit(327), F.lit(True), "若い順"), T.rank_text(F.lit(None).cast("int"), F.lit(1), F.lit(None).cast("boolean"))) == ("364名中3位", "327名中・若い順5位タイ", None)
    assert one(T.monogram(F.lit(None).cast("string"), F.lit("武帝")), T.thumbnail(F.lit("/portraits/a.webp")), T.thumbnail(F.lit("/b"))) == ("武", "/portraits/thumb/a.webp", "/b")
    assert [tuple(x) for x in one(D.claims(F.lit("a →0618-06-18 b =627年1月2日 c → -045-3-1")))[0]] == [(618, 6, 18), (627, 1, 2), (-45, 3, 1)]


def test_summaries_and_details(spark):
    event = lambda **x: {"events": [x]}
    rows = [{"id": "a", "personalCampaignCount": event(target="T"), "rebellionSufferedCount": event(leader="L"), "rebellionSuppressionCount": event(name="N", leader="L"), "capitalRelocationCount": event(to="Z"), "amnestyCount": event(note="一。二。"), "eraChangeCount": event()}]
    got = {r["kind"]: r["summary"] for r in views.event_summaries(spark.createDataFrame([(rows,)], f"r array<{RECORD}>").select(F.inline("r"))).collect()}
    assert got == {"personalCampaignCount": "T", "rebellionSufferedCount": "Lの反乱", "rebellionSuppressionCount": "N", "capitalRelocationCount": "? → Z", "amnestyCount": "一。", "eraChangeCount": "（記録なし）"}
    flat = spark.createDataFrame([(400, "病死", "不詳", None)], "days int, death_cause string, accession_route string, death_age int")
    assert [tuple(x) for x in flat.select(views.detail_rows("days")).first()[0]] == [("死因", "病死"), ("即位経路", "不詳")]
    assert [x["label"] for x in flat.withColumn("death_age", F.lit(3)).select(views.detail_rows("years")).first()[0]] == ["在位期間", "死因", "即位経路", "没年齢"]
