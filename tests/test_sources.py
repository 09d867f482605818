"""Readers, writers, streams and search on small files."""

import json

from pyspark.sql import functions as F

from sagaframe.operators import search
from sagaframe.sources import corpus, records, sinks
from sagaframe.streaming import windows


def document(tmp_path):
    reign = lambda a, b: {"startYear": a, "endYear": b, "isRestoration": False}
    rows = [
        {"id": "a", "name": {"personalName": "A", "aliases": ["x"]}, "dynasty": {"name": "D", "section": "S"}, "reigns": [reign(1, 3), reign(5, 6)], "amnestyCount": {"count": 1, "events": [{"date": "0002-01", "note": "n"}]}, "extra": 1},
        {"id": "b", "name": {"personalName": "B", "aliases": []}, "dynasty": {"name": "D", "section": "S"}, "reigns": [], "eraChangeCount": {"count": 0, "events": []}},
    ]
    path = tmp_path / "doc.json"
    path.write_text(json.dumps({"meta": {"title": "t", "count": 2}, "records": rows}, indent=1))
    return str(path)


def test_records(spark, tmp_path):
    path = document(tmp_path)
    meta, rows = records.documents(spark, path)
    assert meta.first()["count"] == 2 and [r["id"] for r in rows.orderBy("ord").collect()] == ["a", "b"]
    assert [(r["id"], r["reign_ix"], r["startYear"]) for r in records.children(rows).orderBy("reign_ix").collect()] == [("a", 0, 1), ("a", 1, 5)]
    assert [(r["id"], r["kind"], r["date"]) for r in records.events(rows).collect()] == [("a", "amnestyCount", "0002-01")]
    known = ["id", "name", "dynasty", "reigns", *records.GROUPS]
    assert [tuple(r) for r in records.unknown_members(spark, path, "records", known).collect()] == [(0, "extra")]


def test_maps_manifests_graphs(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"matches": {"a": ["v1", "v2"], "b": []}}')
    assert [tuple(r) for r in records.map_of_lists(spark, str(tmp_path / "m.json"), "matches").orderBy("pos").collect()] == [("a", 0, "v1"), ("a", 1, "v2")]
    (tmp_path / "l.json").write_text('[{"id": "v1", "title": "T"}]')
    assert records.manifest(spark, str(tmp_path / "l.json"), "id string, title string").first()["title"] == "T"
    (tmp_path / "g.json").write_text('{"persons": [{"id": "p-1"}], "edges": [{"type": "kinship", "from": "p-1", "to": "a"}]}')
    persons, edges = records.graph(spark, str(tmp_path / "g.json"))
    assert persons.count() == 1 and edges.first()["from"] == "p-1"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.webp").write_text("1")
    assert [r["id"] for r in records.file_ids(spark, str(tmp_path / "x"), ".webp").collect()] == ["a"]


def test_ledger_is_empty_when_absent(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert records.ledger(spark, path).count() == 0
    sinks.ledger(spark.createDataFrame([("k2", "cache"), ("k1", "manual")], "key string, status string"), "key", path)
    assert [r["key"] for r in records.ledger(spark, path).orderBy("key").collect()] == ["k1", "k2"]


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'q"x,y', 0.0, False)], "a int, b string, c string, d double, e boolean")
    sinks.csv(df, str(tmp_path / "c"), single=True)
    text = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert text == b'a,b,c,d,e\r\n1,,"q""x,y",0.0,false\r\n'
    sinks.csv_with_bom(df.select("a", "c"), str(tmp_path / "b"))
    assert next((tmp_path / "b").glob("part-*")).read_bytes() == b'\xef\xbb\xbfa,c\r\n1,"q""x,y"\r\n'


def test_keyed_files_and_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    sinks.keyed_json(df, "id", str(tmp_path / "j"))
    sinks.keyed_text(df, "id", "text", str(tmp_path / "t"))
    assert json.loads(next((tmp_path / "j" / "id=a").glob("part-*")).read_text()) == {"text": "x"}
    assert next((tmp_path / "t" / "id=b").glob("part-*")).read_text() == "y\n"
    (tmp_path / "s.json").write_bytes(b'{"a":  1}')
    sinks.copy(spark, str(tmp_path / "s.json"), str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_bytes() == b'{"a":  1}'


def test_linked_data(spark):
    person = lambda names, born: json.loads(spark.range(1).select(sinks.person_document(F.lit("n"), F.array(*map(F.lit, names)).cast("array<string>"), F.lit(born), F.lit(None).cast("string"), F.lit("u"))).first()[0])
    assert person([], "0600") == {"@type": "Person", "name": "n", "birthDate": "0600", "url": "u"}
    assert person(['a"b'], None)["alternateName"] == 'a"b' and person(["a", "b"], None)["alternateName"] == ["a", "b"]
    trail = spark.range(1).select(sinks.breadcrumbs(F.array(F.struct(F.lit("h").alias("name"), F.lit("/").alias("url"))))).first()[0]
    assert json.loads(trail)["itemListElement"][0]["position"] == 1


def test_sitemap_and_assets(spark):
    ids = spark.createDataFrame([("a",)], "id string")
    assert [r["url"] for r in sinks.sitemap(["/", "/about"], ids, "https://x").collect()] == ["https://x/", "https://x/about", "https://x/a/"]
    source = spark.createDataFrame([("a", 2), ("b", 1), ("c", 1)], "id string, modified int")
    target = spark.createDataFrame([("a", 1), ("b", 1), ("z", 1)], "id string, modified int")
    assert {r["id"]: r["action"] for r in sinks.asset_changes(source, target).collect()} == {"a": "write", "b": "keep", "c": "write", "z": "delete"}


def test_corpus(spark, tmp_path):
    for name, body in (("卷二", "second"), ("卷一", "<p>first &amp; only</p>"), ("卷十一", "late")):
        (tmp_path / f"{name}.html").write_text(body)
    found = corpus.chapters(spark, str(tmp_path))
    assert {r["n"]: r["text"] for r in found.collect()} == {1: "first & only", 2: "second", 11: "late"}
    assert corpus.chapter_range(found, 1, 2).first()["text"] == "first & only\n\nsecond"
    specs = [corpus.Extract("a", 1, 2, "only", "sec"), corpus.Extract("b", 11, 11), corpus.Extract("c", 1, 1, "&")]
    assert {r["id"]: r["text"] for r in corpus.extracts(found, specs).collect()} == {"a": "only\n\nsec", "b": "late", "c": "& only"}
    assert spark.range(1).select(corpus.line_range(F.lit("a\nb\nc"), 2, 3)).first()[0] == "b\nc"


def test_provenance_and_containment(spark):
    books = spark.createDataFrame([("p2", "天下大亂之時"), ("p1", "乃天下大，亂之時也"), ("p3", "無")], "path string, text string")
    wanted = spark.createDataFrame([("天下大乱之時",), ("有朋自遠方來",)], "fragment string")
    assert [tuple(r) for r in corpus.provenance(books, wanted, {"乱": "亂"}).collect()] == [("天下大乱之時", "p1")]
    needles = spark.createDataFrame([(1, "abcdefghijklmnop"), (2, "xy"), (3, ""), (4, "zzzzzzzzzzzzzzzz")], "i int, n string")
    hay = spark.createDataFrame([(10, "..abcdefghijklmnop.."), (11, "xy"), (12, None)], "h int, t string")
    for broadcast_bytes in (0, 1 << 20):
        assert {tuple(r) for r in search.contained(needles, hay, "i", "n", "h", "t", broadcast_bytes=broadcast_bytes).collect()} == {(1, 10), (2, 11)}
    none = search.contained(needles.where("i = 3"), hay, "i", "n", "h", "t")
    assert none.collect() == [] and none.columns == ["i", "h"]
    assert list(search.blocks(["ab", "c", "d"], 2)) == [["ab"], ["c", "d"]]


def test_staged_search(spark):
    units = spark.createDataFrame([(1, "the quick brown fox"), (2, "jumps over…lazy dogs tonight"), (3, "nothing like it at all")], "i int, s string")
    hay = spark.createDataFrame([(7, "see the quick brown fox run"), (8, "it jumps over x")], "d int, t string")
    assert {tuple(r) for r in search.staged(units, hay, "i", "s", "d", "t").collect()} == {(1, "whole", 7), (2, "fragment", 8)}


def test_staged_search_counts_parts_in_the_whole_corpus(spark):
    units = spark.createDataFrame([(1, "ABCDEFGHIJ⋯klmnopqrst...uvwxyzab——0123456789"), (2, "only in its own text"), (3, "ABCDEFGHIJ/not there/nor there")], "i int, s string")
    hay = spark.createDataFrame([(9, "..klmnopqrst.."), (7, "x uvwxyzab"), (8, "UVWXYZAB, klmnopqrst")], "d int, t string")
    own = spark.createDataFrame([(2, "it is ONLY IN ITS own text"), (1, "nothing")], "i int, text string")
    got = {tuple(r) for r in search.staged(units, hay, "i", "s", "d", "t", own, F.lower).collect()}
    # of the first unit's four parts two are found, in different documents; the first of them in 8 and 9
    assert got == {(1, "fragment", 8), (2, "own", None)}


def test_token_search(spark):
    df = spark.createDataFrame([(1, "abc かな"), (2, "abc")], "i int, t string")
    assert [r["i"] for r in search.multi_token(df, F.col("t"), " ａｂｃ　カナ ").collect()] == [1]
    got = search.in_context(spark.createDataFrame([(1, "x\nyy needle z")], "i int, t string"), "i", "t", "needle", 4).first()
    assert (got["line"], got["excerpt"]) == (2, "\nyy need"[0:8])


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:59:00")]
    spark.createDataFrame(rows, "u int, t string").select("u", F.col("t").cast("timestamp").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("u int, t timestamp").parquet(str(tmp_path / "in"))
    hourly = windows.drain(windows.counts(stream(), "t", ["u"]), str(tmp_path / "c1"))
    assert sorted((r["start"].hour, r["u"], r["n"]) for r in hourly.collect()) == [(0, 1, 2), (0, 2, 1), (3, 1, 1)]
    spans = windows.drain(windows.sessions(stream(), "t", ["u"]), str(tmp_path / "c2"))
    assert sorted((r["u"], r["n"]) for r in spans.collect()) == [(1, 1), (1, 2), (2, 1)]
    fresh = windows.drain(windows.first_seen(stream(), "t", "u"), str(tmp_path / "c3"), "append")
    assert sorted(r["u"] for r in fresh.collect()) == [1, 2]
