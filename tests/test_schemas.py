"""Compiled schemas against a plain walk over the same values, and paths against nested loops."""

import json
import re

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sagaframe.operators import paths, schemas

SCHEMA = {
    "type": "object", "required": ["id", "rows"], "$defs": {"span": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["number", "null"], "exclusiveMaximum": 10}}}},
    "properties": {
        "id": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2, "maxLength": 4},
        "rows": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "properties": {"span": {"$ref": "#/$defs/span"}, "kind": {"enum": ["x", 1, None, True]}}}},
        "tags": {"type": "object", "patternProperties": {"^t_": {"type": "string"}}, "additionalProperties": {"type": "boolean"}},
        "either": {"anyOf": [{"const": "no"}, {"type": "object", "required": ["z"], "properties": {"z": {}}}]},
        "one": {"oneOf": [{"type": "number"}, {"type": "integer"}, {"type": "string"}]},
    },
}


def is_a(x, name):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {"object": isinstance(x, dict), "array": isinstance(x, list), "string": isinstance(x, str), "boolean": isinstance(x, bool), "null": x is None, "number": number, "integer": number and x == int(x)}[name]


def same(x, c):
    return isinstance(x, bool) == isinstance(c, bool) and x == c


def plain(s, x, path="$", closed=False):
    """(path, rule) of each violation."""
    if "$ref" in s:
        s = SCHEMA["$defs"][s["$ref"].rsplit("/", 1)[1]]
    out, kinds = [], [s["type"]] if isinstance(s.get("type"), str) else s.get("type")
    tell = lambda rule, bad: out.extend([(path, rule)] * bool(bad))
    tell("type", kinds and not any(is_a(x, k) for k in kinds))
    tell("enum", "enum" in s and not any(same(x, c) for c in s["enum"]))
    tell("const", "const" in s and not same(x, s["const"]))
    if is_a(x, "number"):
        tell("minimum", "minimum" in s and x < s["minimum"])
        tell("exclusiveMaximum", "exclusiveMaximum" in s and x >= s["exclusiveMaximum"])
    if isinstance(x, str):
        tell("pattern", "pattern" in s and not re.search(s["pattern"], x))
        tell("minLength", "minLength" in s and len(x) < s["minLength"])
        tell("maxLength", "maxLength" in s and len(x) > s["maxLength"])
    if isinstance(x, list):
        tell("minItems", "minItems" in s and len(x) < s["minItems"])
        tell("maxItems", "maxItems" in s and len(x) > s["maxItems"])
        for i, y in enumerate(x):
            out += plain(s.get("items", {}), y, f"{path}[{i}]", closed)
    if isinstance(x, dict):
        for name in s.get("required", []):
            tell("required", name not in x)
        rest = s.get("additionalProperties", not (closed and "properties" in s))
        for name, y in x.items():
            subs = [s["properties"][name]] if name in s.get("properties", {}) else []
            subs += [sub for p, sub in s.get("patternProperties", {}).items() if re.search(p, name)]
            if not subs and rest is False:
                tell("additionalProperties", True)
            for sub in subs or ([rest] if isinstance(rest, dict) else []):
                out += plain(sub, y, f"{path}.{name}", closed)
    if "anyOf" in s:
        tell("anyOf", all(plain(b, x, path, closed) for b in s["anyOf"]))
    if "oneOf" in s:
        tell("oneOf", sum(not plain(b, x, path, closed) for b in s["oneOf"]) != 1)
    return out


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-3, 12), st.sampled_from([0.5, 2.0, 10.0]), st.sampled_from(["", "x", "ab", "abcde", "A1", "no", "日本"]))
SPAN = st.one_of(LEAF, st.dictionaries(st.sampled_from("abc"), LEAF, max_size=3))
ROW = st.one_of(LEAF, st.fixed_dictionaries({}, optional={"span": SPAN, "kind": LEAF, "more": LEAF}))
VALUE = st.one_of(LEAF, st.fixed_dictionaries({}, optional={"id": LEAF, "rows": st.one_of(LEAF, st.lists(ROW, max_size=4)), "tags": st.dictionaries(st.sampled_from(["t_a", "t.b", "u"]), LEAF), "either": st.one_of(LEAF, SPAN, st.just({"z": 1})), "one": LEAF, "it's": LEAF}))


@settings(max_examples=3, phases=[Phase.generate], deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow, HealthCheck.large_base_example, HealthCheck.data_too_large])
@given(st.lists(VALUE, min_size=60, max_size=60))
def test_against_a_plain_walk(spark, made):
    df = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate(made)], "i int, j string")
    for closed in (False, True):
        got = sorted((int(r["key"]), r["path"], r["rule"]) for r in schemas.violations(df, "j", "i", SCHEMA, closed).collect())
        assert got == sorted((i, *v) for i, x in enumerate(made) for v in plain(SCHEMA, x, closed=closed))


def test_texts_that_are_no_json_and_nulls(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, '{"id":"ab","rows":[{"span":{"a":-1,"q":null}}]}'), (4, "")], "i int, j string")
    got = {tuple(r) for r in schemas.violations(df, "j", "i", SCHEMA, True).collect()}
    assert got == {("1", "$", "json", ""), ("4", "$", "json", ""), ("3", "$.rows[0].span.a", "minimum", "-1"), ("3", "$.rows[0].span", "additionalProperties", "q")}


@pytest.mark.parametrize("schema", [{"uniqueItems": True}, {"$ref": "#"}, {"$ref": "other.json"}, {"const": {}}])
def test_what_has_no_check_is_refused(spark, schema):
    with pytest.raises(ValueError):
        schemas.compiled(schema, F.parse_json(F.lit("1")), F.lit("$"))


def test_paths(spark):
    rows = [(1, {"n": "a/b/", "m": None}, [{"q": "x", "in": [{"t": "u"}, {"t": None}, {"t": "v"}]}, None, {"q": None, "in": None}]), (2, None, None), (3, {"n": None, "m": "k"}, [])]
    df = spark.createDataFrame(rows, "id int, o struct<n:string,m:string>, r array<struct<q:string,in:array<struct<t:string>>>>")
    got = sorted(tuple(x) for x in paths.values(df, "id", [paths.Path("r[*].in[*].t", "r{}-{}"), paths.Path("r[*].q", "q[{}]"), paths.Path("o.n", "n", lambda c: F.transform(F.split(c, "/"), lambda x: F.nullif(x, F.lit(""))), True), paths.Path("o.m", "m")]).collect())
    assert got == [(1, "n#0", "a"), (1, "n#1", "b"), (1, "q[0]", "x"), (1, "r0-0", "u"), (1, "r0-2", "v"), (3, "m", "k")]
    with pytest.raises(ValueError):
        paths.values(df, "id", [paths.Path("o.m", "{}")])


def test_structs_are_checked_by_their_fields_as_their_json_is(spark):
    schema = {
        "type": "object", "required": ["id", "head"], "properties": {
            "id": {"type": "string"}, "head": {"type": "object", "required": ["flag"], "properties": {"flag": {"type": "string", "pattern": "^[AR]$", "maxLength": 2}, "on": {"const": True}}},
            "lines": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 2}, "x": {"enum": [1, 2.5]}}}}, "gone": {"type": "number"},
        },
    }
    kind = "id int, head struct<flag:string,on:boolean>, lines array<struct<n:double,x:double,more:string>>"
    rows = [(1, ("A", True), [(2.0, 1.0, None)]), (2, ("BBB", False), []), (3, None, None), (4, (None, None), [(1.5, 3.0, "m"), (None, 2.5, None), (2.0, None, "")]), (None, ("R", True), [(3.0, 1.0, "x")])]
    df = spark.createDataFrame(rows, kind).select(F.monotonically_increasing_id().alias("k"), F.struct("id", "head", F.filter(F.coalesce("lines", F.array()), lambda x: x.isNotNull()).alias("lines")).alias("v"))
    assert df.schema["v"].dataType["lines"].dataType.containsNull
    for closed in (False, True):
        with pytest.raises(ValueError, match="checked as JSON only"):
            schemas.violations(df, "v", "k", schema, closed)
    lines = F.sort_array(F.collect_list(F.when(F.col("l.n").isNotNull() | F.col("l.x").isNotNull() | F.col("l.more").isNotNull(), F.col("l"))))
    told = df.select("k", "v.id", "v.head", F.explode_outer("v.lines").alias("l")).groupBy("k").agg(F.first("id").alias("id"), F.first("head").alias("head"), lines.alias("lines"))
    told = told.select("k", F.struct("id", "head", "lines").alias("v"))
    for closed in (False, True):
        got = sorted(map(tuple, schemas.violations(told, "v", "k", schema, closed).select("key", "path", "rule").collect()))
        want = sorted(map(tuple, schemas.violations(told.withColumn("v", F.to_json("v")), "v", "k", schema, closed).select("key", "path", "rule").collect()))
        assert got == want and len(got) > 10
