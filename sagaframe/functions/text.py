"""String functions as column expressions; the two that Spark has no expression for are Arrow UDFs."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed range: katakana from U+30A1 to U+30F6 stand 0x60 above their hiragana.
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRAGANA = "".join(chr(ord(c) - 0x60) for c in KATAKANA)
HAN = "㐀-鿿"


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else html.unescape(x))


def hiragana(c: Column) -> Column:
    return F.translate(c, KATAKANA, HIRAGANA)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def display_name(*names: Column, default: str) -> Column:
    """The first name that isn't null."""
    return F.coalesce(*names, F.lit(default))


def search_text(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by a space."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " ")


def separated(c: Column) -> Column:
    """Opening brackets become a middle dot, closing ones go; repeated dots are one and none stands at the ends."""
    dotted = F.regexp_replace(F.regexp_replace(c, "[（(〔［\\[]", "・"), "[）)〕］\\]]", "")
    return F.regexp_replace(F.regexp_replace(dotted, "・+", "・"), "^・|・$", "")


def first_sentence(c: Column, stop: str = "。") -> Column:
    """Up to the first stop, included; the whole without one; null for an empty text."""
    return F.when(c == "", None).when(F.instr(c, stop) > 0, F.substring(c, F.lit(1), F.instr(c, stop) + len(stop) - 1)).otherwise(c)


def truncated(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def subtitle(name: Column, title: Column, key: Column | None = None, overrides: dict[str, str | None] | None = None) -> Column:
    """An override by key (also one of null), else the name before a bracket, unless the title has it."""
    short = F.substring_index(name, "（", 1)
    plain = F.when(~title.contains(short), short)
    if not overrides:
        return plain
    listed = F.create_map(*(x for k, v in overrides.items() for x in (F.lit(k), F.lit(v).cast("string"))))
    return F.when(F.map_contains_key(listed, key), F.element_at(listed, key)).otherwise(plain)


def qualified(name: Column, ambiguous: Column, suffix: Column) -> Column:
    """The name, with its suffix in brackets where it is ambiguous and differs from the suffix."""
    return F.when(ambiguous & (name != suffix), F.concat(name, F.lit("（"), suffix, F.lit("）"))).otherwise(name)


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def han_only(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{HAN}]", "")


def mapped(c: Column, variants: dict[str, str]) -> Column:
    """Single characters replaced by their variants."""
    return F.translate(c, "".join(variants), "".join(variants.values()))


def for_match(c: Column, variants: dict[str, str]) -> Column:
    return mapped(han_only(c), variants)


def expansions(chars: Column, readings: Column, cap: int = 8) -> Column:
    """All strings that the readings (a map from character to array) of an array of characters make, cut to
    ``cap`` after each character; a character without readings is an error."""
    known = lambda c: F.coalesce(F.element_at(readings, c), F.raise_error(F.concat(F.lit("no reading for "), c)).cast("array<string>"))
    return F.aggregate(chars, F.array(F.lit("")), lambda acc, c: F.slice(F.flatten(F.transform(acc, lambda p: F.transform(known(c), lambda x: F.concat(p, x)))), 1, cap))


def quoted(c: Column, opening: str = "「", closing: str = "」", least: int = 6, kind: str = HAN, not_kind: str = "ぁ-ヿ") -> Column:
    """Quoted spans with enough characters of a kind and none of another."""
    spans = F.regexp_extract_all(c, F.lit(f"{opening}([^{closing}]*){closing}"), F.lit(1))
    return F.filter(spans, lambda x: ~x.rlike(f"[{not_kind}]") & (F.length(F.regexp_replace(x, f"[^{kind}]", "")) >= least))


def unit_key(key: Column, path: Column, span: Column) -> Column:
    """id|path|first twelve digits of the span's SHA-1."""
    return F.concat_ws("|", key.cast("string"), path, F.substring(F.sha1(span), 1, 12))


#: What separates the parts of a quotation.
PARTS = r"[…⋯]+|\.{3,}|——|/|／"


def fragments(c: Column, normal: Callable[[Column], Column] = lambda c: c, size: int = 10, least: int = 6, most: int = 4) -> Column:
    """Of each part between ellipses, dashes or slashes, made ``normal``, the first ``size`` characters, and as many
    from its middle if it is twice as long; short parts are left out."""
    parts = F.filter(F.transform(F.split(c, PARTS), normal), lambda p: F.length(p) >= least)
    middle = lambda p: F.substring(p, F.floor(F.length(p) / 2).cast("int") + 1, F.lit(size))
    taken = F.transform(parts, lambda p: F.when(F.length(p) >= 2 * size, F.array(F.substring(p, 1, size), middle(p))).otherwise(F.array(F.substring(p, 1, size))))
    return F.slice(F.flatten(taken), 1, most)


def sliding_fragments(c: Column, size: int = 6, step: int = 3, most: int = 8, least: int = 4) -> Column:
    """Windows of ``size`` characters every ``step``; a shorter text as a whole if it has ``least``."""
    many = F.slice(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1), F.lit(step)), lambda i: F.substring(c, i, F.lit(size))), 1, most)
    return F.when(F.length(c) >= size, many).when(F.length(c) >= least, F.array(c)).otherwise(F.array().cast("array<string>"))


def gap_pattern(c: Column, kind: str = HAN, gap: int = 3) -> Column:
    """A pattern that lets up to ``gap`` characters of other kinds stand between each two."""
    return F.array_join(F.filter(F.split(c, ""), lambda x: x != ""), f"[^{kind}]{{0,{gap}}}")


def slice_between(c: Column, start: str, end: str) -> Column:
    """From ``start`` to the first ``end`` after it, both included; a missing marker is an error."""
    a = F.instr(c, start)
    b = F.locate(end, c, 1) if start == "" else F.instr(F.substring(c, a + len(start), F.length(c)), end)
    missing = F.raise_error(F.lit(f"no {start} ... {end}"))
    return F.when((a == 0) | (b == 0), missing).otherwise(F.substring(c, a, len(start) + b - 1 + len(end)))


def slice_from(c: Column, start: str) -> Column:
    a = F.instr(c, start)
    return F.when(a == 0, F.raise_error(F.lit(f"no {start}"))).otherwise(F.substring(c, a, F.length(c)))


def split_at(c: Column, marker: str) -> Column:
    """struct(head, tail), the tail from the marker on."""
    a = F.instr(c, marker)
    return F.when(a == 0, F.raise_error(F.lit(f"no {marker}"))).otherwise(F.struct(F.substring(c, F.lit(1), a - 1).alias("head"), F.substring(c, a, F.length(c)).alias("tail")))


def strip_html(c: Column, blocks: tuple[str, ...] = ("title", "style", "script", "h1", "nav")) -> Column:
    """The text of a page: blocks and tags gone, lines trimmed, empty ones dropped; entities stay (see ``unescaped``)."""
    for block in blocks:
        c = F.regexp_replace(c, f"(?s)<{block}[ >].*?</{block}>", "\n")
    lines = F.split(F.regexp_replace(c, r"(?s)<[^>]*>", "\n"), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != ""), "\n")


def csv_cell(c: Column) -> Column:
    """RFC 4180: quoted if it holds a comma, quote or line break; null is empty."""
    s = c.cast("string")
    return F.when(s.isNull(), "").when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def null_claim(note: Column, field: str, reach: int = 40) -> Column:
    """Whether a note says, within ``reach`` characters, that a field is null."""
    return note.rlike(f"(?s){field}.{{0,{reach}}}null")


def in_whitelist(c: Column, keywords: list[str], markers: list[str], exact: list[str]) -> Column:
    """Whether a title has a keyword or a marker, or is listed."""
    has = lambda ks: F.exists(F.array(*map(F.lit, ks)), lambda k: F.contains(c, k))
    return has(keywords) | has(markers) | c.isin(exact)


def context_label(label: Column, name: Column, context: Column) -> Column:
    """The label with its context in brackets, unless it has the context in it or the context has the name."""
    return F.when(label.contains(context) | context.contains(name), label).otherwise(F.concat(label, F.lit("（"), context, F.lit("）")))


def age_text(age: Column) -> Column:
    return F.coalesce(F.concat(age.cast("string"), F.lit("歳（数え年）")), F.lit("不詳"))


def rank_text(rank: Column, total: Column, tied: Column, direction: str = "") -> Column:
    """Rank among so many, and whether it is shared; null without a rank."""
    return F.concat(total.cast("string"), F.lit("名中" + (f"・{direction}" if direction else "")), rank.cast("string"), F.lit("位"), F.when(tied, "タイ").otherwise(""))


def monogram(personal: Column, name: Column) -> Column:
    return F.substring(F.coalesce(personal, name), 1, 1)


def thumbnail(url: Column, folder: str = "/portraits/") -> Column:
    """The address of the small picture that lies in a folder ``thumb`` of the first ``folder``."""
    at = F.instr(url, folder)
    head, tail = F.substring(url, F.lit(1), at + len(folder) - 1), F.substring(url, at + len(folder), F.length(url))
    return F.when(at > 0, F.concat(head, F.lit("thumb/"), tail)).otherwise(url)
