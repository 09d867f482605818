"""Paths with wildcards over nested columns, compiled into nested transforms that keep the place of each value."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FOUND = "array<struct<path:string,value:string>>"


@dataclass(frozen=True)
class Path:
    """``steps`` like ``a[*].b.c``; ``label`` names a value, with ``{}`` for each place in an array; ``pieces`` makes
    an array of a text, of which each is a value (``numbered`` ones get ``#`` and their place)."""

    steps: str
    label: str
    pieces: Callable[[Column], Column] | None = None
    numbered: bool = False


def _label(template: str, places: list[Column]) -> Column:
    texts = template.split("{}")
    if len(texts) != len(places) + 1:
        raise ValueError(f"{template} has {len(texts) - 1} places, its path {len(places)}")
    return F.concat(*(x for text, place in zip(texts, [*places, None]) for x in (F.lit(text), *([place.cast("string")] if place is not None else []))))


def _found(value: Column, steps: list[str], path: Path, places: list[Column]) -> Column:
    none = F.array().cast(_FOUND)
    if not steps:
        label = _label(path.label, places)
        if path.pieces is None:
            return F.when(value.isNull(), none).otherwise(F.array(F.struct(label.alias("path"), value.cast("string").alias("value"))))
        name = (lambda i: F.concat(label, F.lit("#"), i)) if path.numbered else (lambda i: label)
        each = F.transform(path.pieces(value), lambda x, i: F.struct(name(i).alias("path"), x.alias("value")))
        return F.coalesce(F.filter(each, lambda x: x["value"].isNotNull()), none)
    step, rest = steps[0], steps[1:]
    inner = value[step.removesuffix("[*]")]
    if not step.endswith("[*]"):
        return _found(inner, rest, path, places)
    return F.coalesce(F.flatten(F.transform(inner, lambda x, i: _found(x, rest, path, [*places, i]))), none)


def values(df: DataFrame, key: str, paths: list[Path]) -> DataFrame:
    """(key, path, value): every text that one of the paths leads to, in one pass over the rows.

    Nulls on the way lead to nothing. Only the members that a path names are read.
    """
    found = []
    for path in paths:
        first, *rest = path.steps.split(".")
        found.append(_found(F.struct(F.col(first.removesuffix("[*]"))), [first, *rest], path, []))
    return df.select(F.col(key), F.inline(F.concat(*found)))
