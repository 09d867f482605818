"""JSON Schemas compiled into one projection that lists the violations at every level of a value.

A schema becomes nested expressions over VARIANT: each definition binds its value once, tests it and goes on
to its members and elements. Structs are checked by their fields, with no JSON made or parsed and with types
that are known beforehand. Rows are checked where they are read, without a shuffle and without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = "array<struct<path:string,rule:string,detail:string>>"
#: The keywords of a schema that say nothing of values.
NOTES = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
#: The keywords that hold one schema, a list and a map of schemas.
ONE, LISTED, MAPPED = ("items", "additionalProperties", "not"), ("anyOf", "oneOf", "allOf"), ("properties", "patternProperties", "$defs", "definitions")
BOUNDS: dict[str, Callable[[Column, Any], Column]] = {
    "minimum": lambda x, n: x < n, "maximum": lambda x, n: x > n, "exclusiveMinimum": lambda x, n: x <= n, "exclusiveMaximum": lambda x, n: x >= n,
}


def strict(schema: Any) -> Any:
    """The schema in which every object that lists its properties has no others, unless it says so itself."""
    if not isinstance(schema, dict):
        return schema
    out = dict(schema)
    for word in ONE:
        if word in out:
            out[word] = strict(out[word])
    for word in LISTED:
        if word in out:
            out[word] = [strict(x) for x in out[word]]
    for word in MAPPED:
        if word in out:
            out[word] = {name: strict(x) for name, x in out[word].items()}
    if "properties" in out:
        out.setdefault("additionalProperties", False)
    return out


#: The types of columns whose values are checked as they are, by the kind that a VARIANT would have.
KINDS: dict[str, tuple[type, ...]] = {
    "OBJECT": (T.StructType,), "ARRAY": (T.ArrayType,), "STRING": (T.StringType,), "BOOLEAN": (T.BooleanType,),
    "BIGINT": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "DOUBLE": (T.FloatType, T.DoubleType), "DECIMAL": (T.DecimalType,),
}


class Typed(NamedTuple):
    """A value of a known type; null is absent, as in the JSON of a struct."""

    column: Column
    of: T.DataType

    @property
    def kind(self) -> str:
        for kind, types in KINDS.items():
            if isinstance(self.of, types) and not (kind == "ARRAY" and self.of.containsNull):
                return kind
        raise ValueError(f"a type that is checked as JSON only: {self.of.simpleString()}")


def _none() -> Column:
    return F.array().cast(FOUND)


def _one(bad: Column, path: Column, rule: str, detail: Column | str) -> Column:
    told = F.struct(path.alias("path"), F.lit(rule).alias("rule"), (F.lit(detail) if isinstance(detail, str) else detail).cast("string").alias("detail"))
    return F.when(bad, F.array(told)).otherwise(_none())


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _text(v: Column) -> Column:
    return F.to_json(v.column) if isinstance(v, Typed) and v.kind in ("OBJECT", "ARRAY") else v.column.cast("string") if isinstance(v, Typed) else F.try_variant_get(v, "$", "string")


def _number(v: Column) -> Column:
    if isinstance(v, Typed):
        return v.column.cast("double") if v.kind in ("BIGINT", "DOUBLE", "DECIMAL") else F.lit(None).cast("double")
    return F.try_variant_get(v, "$", "double")


def _is(v: Column, kind: Column, name: str) -> Column:
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    tests = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": number, "integer": number & (_number(v) % 1 == 0),
    }
    return tests[name]


def _equals(v: Column, kind: Column, constant: Any) -> Column:
    if constant is None:
        return kind == "VOID"
    if isinstance(constant, bool):
        return _is(v, kind, "boolean") & ((v.column if isinstance(v, Typed) else F.try_variant_get(v, "$", "boolean")) == constant)
    if isinstance(constant, str):
        return _is(v, kind, "string") & (_text(v) == constant)
    if isinstance(constant, (int, float)):
        return _is(v, kind, "number") & (_number(v) == float(constant))
    raise ValueError(f"a constant that is an object or a list: {constant!r}")


def _there(v: Column | Typed | None) -> Column:
    return F.lit(False) if v is None else (v.column if isinstance(v, Typed) else v).isNotNull()


def _member(v: Column | Typed, name: str) -> Column | Typed | None:
    """The member; None where a type has no such field."""
    if isinstance(v, Typed):
        return Typed(v.column.getField(name), v.of[name].dataType) if v.kind == "OBJECT" and name in v.of.names else None
    quote = "'" if '"' in name else '"'
    if quote in name:
        raise ValueError(f"a member with both kinds of quotes: {name!r}")
    return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")


def _resolved(root: Any, ref: str) -> Any:
    if not ref.startswith("#"):
        raise ValueError(f"not in this document: {ref}")
    at = root
    for step in filter(None, ref[1:].split("/")):
        at = at[step.replace("~1", "/").replace("~0", "~")]
    return at


def compiled(schema: Any, value: Column, path: Column, root: Any = None, via: tuple[str, ...] = ()) -> Column:
    """The violations of a VARIANT, as an array of struct(path, rule, detail); an absent value has none.

    ``rule`` is the keyword that is broken. Keywords that aren't known are a ValueError, so that no
    assertion is passed over; so is a schema that refers to itself, as its depth has no bound.
    """
    root = schema if root is None else root
    if schema is True or schema == {}:
        return _none()
    if value is None:
        return _none()
    if schema is False:
        return _one(_there(value), path, "false", "")
    if isinstance(value, Typed):
        return F.when(_there(value), _node(schema, value, F.lit(value.kind), path, root, via)).otherwise(_none())
    bound = F.array(F.struct(value.alias("v"), F.schema_of_variant(value).alias("kind")))
    checked = F.flatten(F.transform(bound, lambda b: _node(schema, b["v"], b["kind"], path, root, via)))
    return F.when(value.isNull(), _none()).otherwise(checked)


def _node(schema: dict, v: Column, kind: Column, path: Column, root: Any, via: tuple[str, ...]) -> Column:
    known = {*NOTES, *ONE, *LISTED, *MAPPED, *BOUNDS, "$ref", "type", "enum", "const", "required", "pattern", "minLength", "maxLength", "minItems", "maxItems"}
    if strange := set(schema) - known:
        raise ValueError(f"keywords without a check: {sorted(strange)}")
    out, within = [], lambda s, value=v, at=path, v_=via: compiled(s, value, at, root, v_)
    if ref := schema.get("$ref"):
        if ref in via:
            raise ValueError(f"a schema within itself: {ref}")
        out.append(within(_resolved(root, ref), v_=(*via, ref)))
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        out.append(_one(~reduce(Column.__or__, (_is(v, kind, n) for n in names)), path, "type", "|".join(names)))
    for word in ("enum", "const"):
        if word in schema:
            out.append(_one(~reduce(Column.__or__, (_equals(v, kind, c) for c in (schema[word] if word == "enum" else [schema[word]]))), path, word, _text(v)))
    for word, beyond in BOUNDS.items():
        if word in schema:
            out.append(_one(_is(v, kind, "number") & beyond(_number(v), float(schema[word])), path, word, _text(v)))
    texts = {"pattern": lambda x, n: ~x.rlike(n), "minLength": lambda x, n: F.length(x) < n, "maxLength": lambda x, n: F.length(x) > n}
    for word, bad in texts.items():
        if word in schema:
            out.append(_one(_is(v, kind, "string") & bad(_text(v), schema[word]), path, word, _text(v)))
    return _all(out + _members(schema, v, kind, path, within) + _elements(schema, v, kind, path, within) + _choices(schema, path, within))


def _members(schema: dict, v: Column, kind: Column, path: Column, within: Callable) -> list[Column]:
    listed, patterns, rest = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    is_object = _is(v, kind, "object")
    out = [_one(is_object & ~_there(_member(v, name)), path, "required", name) for name in schema.get("required", [])]
    out += [F.when(is_object, within(sub, _member(v, name), F.concat(path, F.lit(f".{name}")))).otherwise(_none()) for name, sub in listed.items()]
    if isinstance(v, Typed):
        if patterns:
            raise ValueError("patterns of members are checked in JSON only")
        for name in v.of.names if v.kind == "OBJECT" and rest is not True else ():
            if name not in listed:
                out.append(_one(_there(_member(v, name)), path, "additionalProperties", name) if rest is False else within(rest, _member(v, name), F.concat(path, F.lit(f".{name}"))))
        return out
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    named = lambda of, pattern: F.filter(of, lambda e: e["key"].rlike(pattern))
    each = lambda of, sub: F.flatten(F.transform(of, lambda e: within(sub, e["value"], F.concat(path, F.lit("."), e["key"]))))
    for pattern, sub in patterns.items():
        out.append(F.when(is_object, each(named(entries, pattern), sub)).otherwise(_none()))
    if rest is not True:
        names = F.array(*map(F.lit, listed)).cast("array<string>")
        other = F.filter(entries, lambda e: ~reduce(Column.__or__, (e["key"].rlike(p) for p in patterns), F.array_contains(names, e["key"])))
        if rest is False:
            told = F.transform(other, lambda e: F.struct(path.alias("path"), F.lit("additionalProperties").alias("rule"), e["key"].alias("detail")))
        else:
            told = each(other, rest)
        out.append(F.when(is_object, told).otherwise(_none()))
    return out


def _elements(schema: dict, v: Column, kind: Column, path: Column, within: Callable) -> list[Column]:
    if isinstance(v, Typed) and v.kind != "ARRAY":
        return []
    is_array, elements = _is(v, kind, "array"), v.column if isinstance(v, Typed) else F.try_variant_get(v, "$", "array<variant>")
    element = lambda x: Typed(x, v.of.elementType) if isinstance(v, Typed) else x
    out = []
    for word, bad in {"minItems": lambda n: F.size(elements) < n, "maxItems": lambda n: F.size(elements) > n}.items():
        if word in schema:
            out.append(_one(is_array & bad(schema[word]), path, word, F.size(elements)))
    if "items" in schema:
        each = F.transform(elements, lambda x, i: within(schema["items"], element(x), F.concat(path, F.lit("["), i, F.lit("]"))))
        out.append(F.when(is_array, F.flatten(each)).otherwise(_none()))
    return out


def _choices(schema: dict, path: Column, within: Callable) -> list[Column]:
    fits = lambda word: [F.size(within(s)) == 0 for s in schema[word]]
    out = [within(s) for s in schema.get("allOf", [])]
    if "anyOf" in schema:
        out.append(_one(~reduce(Column.__or__, fits("anyOf")), path, "anyOf", ""))
    if "oneOf" in schema:
        out.append(_one(reduce(Column.__add__, (x.cast("int") for x in fits("oneOf"))) != 1, path, "oneOf", ""))
    if "not" in schema:
        out.append(_one(F.size(within(schema["not"])) == 0, path, "not", ""))
    return out


def violations(df: DataFrame, json: str, key: str, schema: dict, closed: bool = False, root: dict | None = None, start: Column | str = "$") -> DataFrame:
    """(key, path, rule, detail) of the JSON texts that break a schema, or with ``closed`` its strict form.

    A text that isn't JSON breaks the rule ``json``; a null text breaks none. ``json`` may also be a struct of structs,
    arrays without nulls, texts, numbers and booleans, checked by its fields: null ones are absent, as in its JSON. ``root`` is the document that
    references point into where ``schema`` is a part of it, ``start`` the path of the value.
    """
    if closed:
        schema, root = strict(schema), strict(root)
    at = F.lit(start) if isinstance(start, str) else start
    if isinstance(of := df.schema[json].dataType, T.StructType):
        rows = df.select(F.col(key).cast("string").alias("key"), at.alias("_at"), F.col(json).alias("_v"))
        return rows.select("key", F.explode(compiled(schema, Typed(F.col("_v"), of), F.col("_at"), root)).alias("_f")).select("key", "_f.*")
    rows = df.select(F.col(key).cast("string").alias("key"), at.alias("_at"), F.col(json).isNotNull().alias("_there"), F.try_parse_json(F.col(json)).alias("_v"))
    unread = _one(F.col("_there"), F.col("_at"), "json", "")
    found = F.when(F.col("_v").isNull(), unread).otherwise(compiled(schema, F.col("_v"), F.col("_at"), root))
    return rows.select("key", F.explode(found).alias("_f")).select("key", "_f.*")
