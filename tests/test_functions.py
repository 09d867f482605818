"""Column functions on literal cases, with nulls."""

import pytest
from pyspark.sql import functions as F

from sagaframe.functions import dates as D
from sagaframe.functions import numbers as N
from sagaframe.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("y, astro", [(-1, 0), (-221, -220), (1, 1), (960, 960)])
def test_years(spark, y, astro):
    assert one(spark, D.astronomical(F.lit(y))) == astro and one(spark, D.historic(F.lit(astro))) == y


@pytest.mark.parametrize("s, want", [("-0210-09-10", (-210, 9, 10)), ("618", None), ("0618", (618, None, None)), ("0618-13", None), ("0618-02-32", None), ("x", None)])
def test_strict_dates(spark, s, want):
    got = one(spark, D.parse_strict(F.lit(s)))
    assert (None if got is None else tuple(got)) == want


def test_loose_clamp_iso_key(spark):
    p = D.clamp(D.parse_loose(F.lit("-87-3-9")), D.precision(F.lit("lunar-month")))
    assert one(spark, D.iso(p)) == "-0087-03" and one(spark, D.sort_key(p)) == -869700
    assert one(spark, D.precision(F.lit("no idea"))) == "year"
    assert one(spark, D.precision_of(F.lit('{"start": "day", "end": "year"}'), "end")) == "year"
    assert one(spark, D.precision_of(F.lit('"month"'), "start")) == "month"
    assert one(spark, D.depth(D.parse_strict(F.lit("0618-02")))) == 2


def test_compare_at_common_precision(spark):
    c = lambda a, b: one(spark, D.compare(D.parse_strict(F.lit(a)), D.parse_strict(F.lit(b))))
    assert (c("0618", "0618-05"), c("0618-04", "0618-05-01"), c("0619", "0618-12-31")) == (0, -1, 1)


@pytest.mark.parametrize("y, m, d, want", [(2000, 1, 1, 2451545), (1582, 10, 15, 2299161), (1582, 10, 4, 2299160), (100, 2, 29, 1757642), (-4712, 1, 1, 0)])
def test_julian_days(spark, y, m, d, want):
    assert one(spark, D.jdn(F.lit(y), F.lit(m), F.lit(d))) == want


def test_spans_of_days(spark):
    days = lambda a, b: one(spark, D.exact_days(D.parse_strict(F.lit(a)), D.parse_strict(F.lit(b))))
    assert days("1582-10-04", "1582-10-15") == 1 and days("0618", "0619-01-01") is None
    assert one(spark, D.duration(F.lit(730))) == "2年" and one(spark, D.duration(F.lit(400))) == "1年35日" and one(spark, D.duration(F.lit(0))) == "1日未満"
    assert one(spark, D.period(F.lit(-3), F.lit(5))) == "前3–5年" and one(spark, D.counted_age(F.lit(600), F.lit(618))) == 19
    assert one(spark, D.display_years_fit(F.lit(1000), F.lit(2.74))) is True and one(spark, D.display_years_fit(F.lit(1000), F.lit(3.1))) is False


def test_claims_and_conventions(spark):
    d = D.parse_strict(F.lit("-0209-01-05"))
    assert one(spark, D.bce_convention(F.lit("前210年に"), d)) is True and one(spark, D.bce_convention(F.lit("no year"), d)) is None
    assert [tuple(x) for x in one(spark, D.claims(F.lit("x →0618-06-18 y →0627-01-02")))] == [(618, 6, 18), (627, 1, 2)]
    assert one(spark, D.year_matches_date(F.lit(618), D.parse_strict(F.lit("0618")))) is True


def test_numbers(spark):
    assert [one(spark, N.kanji_number(F.lit(x))) for x in ("十", "二十三", "一〇四", "五", "x")] == [10, 23, 104, 5, None]
    assert one(spark, N.integer_ticks(F.lit(14))) == [0, 2, 4, 6, 8, 10, 12, 14]
    assert one(spark, N.piecewise(F.lit(15.0), [(0, 0), (10, 100), (20, 110)])) == 105 and one(spark, N.one_decimal(F.lit(2))) == "2.0"


def test_texts(spark):
    assert one(spark, T.nfkc(F.lit("ＡＢ１"))) == "AB1" and one(spark, T.hiragana(F.lit("カナx"))) == "かなx" and one(spark, T.unescaped(F.lit("a&amp;b"))) == "a&b"
    assert one(spark, T.separated(F.lit("（a）b〔c〕"))) == "ab・c"
    assert one(spark, T.first_sentence(F.lit("一。二。"))) == "一。" and one(spark, T.first_sentence(F.lit(""))) is None and one(spark, T.first_sentence(F.lit("一"))) == "一"
    assert one(spark, T.truncated(F.lit("abcdef"), 3)) == "abc…" and one(spark, T.strip_prefix(F.lit("xyz"), "x")) == "yz"
    assert one(spark, T.search_text(F.lit("a"), F.lit(None), F.lit(""), F.lit("b"))) == "a b"
    assert one(spark, T.display_name(F.lit(None), F.lit("b"), default="z")) == "b" and one(spark, T.null_if_empty(F.lit(""))) is None


def test_subtitles(spark):
    assert one(spark, T.subtitle(F.lit("name（x）"), F.lit("title"))) == "name" and one(spark, T.subtitle(F.lit("tit"), F.lit("title"))) is None
    listed = {"k": None, "m": "M"}
    assert one(spark, T.subtitle(F.lit("n"), F.lit("t"), F.lit("k"), listed)) is None and one(spark, T.subtitle(F.lit("n"), F.lit("t"), F.lit("m"), listed)) == "M"
    assert one(spark, T.qualified(F.lit("a"), F.lit(True), F.lit("b"))) == "a（b）" and one(spark, T.qualified(F.lit("a"), F.lit(True), F.lit("a"))) == "a"


def test_readings(spark):
    table = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array(F.lit("3")))
    assert one(spark, T.expansions(F.array(F.lit("a"), F.lit("b"), F.lit("a")), table, 3)) == ["131", "132", "231"]
    with pytest.raises(Exception, match="no reading for z"):
        one(spark, T.expansions(F.array(F.lit("z")), table))


def test_quotations(spark):
    assert one(spark, T.quoted(F.lit("「天下大亂之時也」「かな天下大亂之時」「短」"))) == ["天下大亂之時也"]
    assert one(spark, T.fragments(F.lit("abcdefghijklmnopqrst…xyz/uvwxyzab"))) == ["abcdefghij", "klmnopqrst", "uvwxyzab"]
    assert one(spark, T.sliding_fragments(F.lit("abcdefghij"))) == ["abcdef", "defghi"] and one(spark, T.sliding_fragments(F.lit("abcd"))) == ["abcd"] and one(spark, T.sliding_fragments(F.lit("abc"))) == []
    assert one(spark, F.regexp(F.lit("天、下"), T.gap_pattern(F.lit("天下")))) is True
    assert one(spark, T.for_match(F.lit("x天，乱y"), {"乱": "亂"})) == "天亂" and one(spark, T.unit_key(F.lit(7), F.lit("p"), F.lit("s"))).startswith("7|p|")


def test_slices(spark):
    assert one(spark, T.slice_between(F.lit("xxaYYbzz"), "a", "b")) == "aYYb" and one(spark, T.slice_from(F.lit("xxaYY"), "a")) == "aYY"
    assert tuple(one(spark, T.split_at(F.lit("xxaYY"), "a"))) == ("xx", "aYY")
    for bad in (T.slice_between(F.lit("x"), "a", "b"), T.slice_from(F.lit("x"), "a"), T.split_at(F.lit("x"), "a")):
        with pytest.raises(Exception, match="no a"):
            one(spark, bad)


def test_html_and_csv(spark):
    page = "<title>t</title><p>one </p><script>x</p></script><p>two</p>"
    assert one(spark, T.strip_html(F.lit(page))) == "one\ntwo"
    assert [one(spark, T.csv_cell(F.lit(x))) for x in ("a", 'a"b', "a,b", None, 0)] == ["a", '"a""b"', '"a,b"', "", "0"]
    assert one(spark, T.in_whitelist(F.lit("big blog"), ["blog"], [], [])) is True and one(spark, T.in_whitelist(F.lit("x"), ["blog"], ["utm"], ["y"])) is False
    assert one(spark, T.null_claim(F.lit("age: stays null here"), "age")) is True


def test_parse_strict_makes_and_matches_its_text_once(spark):
    df = spark.createDataFrame([("0618-02-03", 1), ("-0209-01-05", 1), ("0618-02", 1), ("0618-13-01", 1), ("0618-02-00", 1), ("618-02-03", 1), ("0618-02-03x", 1), ("", 1), (None, 1)], "s string, n int")
    parsed = df.select(D.parse_strict(F.concat("s", F.lit(""))).alias("p"))
    plan = parsed._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat(") == 1 and plan.upper().count("RLIKE") == 1 and "regexp_extract" not in plan
    assert [r["p"] and tuple(r["p"]) for r in parsed.collect()] == [(618, 2, 3), (-209, 1, 5), (618, 2, None), None, None, None, None, None, None]
