"""Numbers: scales, numerals, ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of Chinese numerals.
NUMERALS = "〇一二三四五六七八九"


def kanji_number(c: Column) -> Column:
    """Numerals to 99 with 十, or digit by digit without it."""
    ascii_ = F.translate(c, NUMERALS, "0123456789")
    tens, units = F.substring_index(ascii_, "十", 1), F.substring_index(ascii_, "十", -1)
    whole = lambda x, empty: F.when(x == "", empty).otherwise(x.try_cast("int"))
    return F.when(c.contains("十"), whole(tens, 1) * 10 + whole(units, 0)).otherwise(ascii_.try_cast("int"))


def integer_ticks(most: Column) -> Column:
    """0 to ``most`` in steps of 1, 2 or 5, or a tenth, by size."""
    step = F.when(most <= 12, 1).when(most <= 30, 2).when(most <= 60, 5).otherwise(F.ceil(most / 10)).cast("long")
    return F.sequence(F.lit(0).cast("long"), most.cast("long"), step)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points of rising x, and on beyond the first and last two."""
    out = None
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        line = y0 + (x - x0) * ((y1 - y0) / (x1 - x0))
        out = line if out is None else F.when(x < x1, line).otherwise(out)
    return out


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c.cast("double"))
