"""Imprecise and historical dates as whole numbers: Spark's dates know neither BCE years nor the Julian calendar.

Years are historic (no year 0, BCE negative) or astronomical (-1 is 0). A partial date is
struct(y, m, d) with null for what isn't known; y is astronomical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def astronomical(y: Column) -> Column:
    return F.when(y < 0, y + 1).otherwise(y)


def historic(y: Column) -> Column:
    return F.when(y <= 0, y - 1).otherwise(y)


def _part(c: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("int")


def _parsed(c: Column, pattern: str, valid) -> Column:
    y, m, d = (_part(c, pattern, i) for i in (1, 2, 3))
    return F.when(c.rlike(pattern) & valid(m, d), F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def parse_loose(c: Column) -> Column:
    """[-]Y to [-]YYYY, with month and day if given, of any size; null if it is none."""
    return _parsed(c, r"^([+-]?\d{1,4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$", lambda m, d: F.lit(True))


def parse_strict(c: Column) -> Column:
    """Four digits of year, two of month (1 to 12) and day (1 to 31).

    The text is made once, however long that takes, and matched once: its parts have fixed places.
    """

    def made(c: Column) -> Column:
        bce = F.when(c.startswith("-"), 1).otherwise(0)
        part = lambda at: F.when(c.substr(at + bce, F.lit(1)) == "-", c.substr(at + 1 + bce, F.lit(2)).cast("int"))
        parts = F.struct(c.substr(F.lit(1), 4 + bce).cast("int").alias("y"), part(F.lit(5)).alias("m"), part(F.lit(8)).alias("d"))
        return F.when(c.rlike(r"^-?\d{4}(?:-(?:0[1-9]|1[0-2])(?:-(?:0[1-9]|[12]\d|3[01]))?)?$"), parts)

    return F.get(F.transform(F.array(c), made), F.lit(0))


def precision(c: Column) -> Column:
    """day, month or year from a free token; unknown ones are year, which is safe."""
    return F.when(c.rlike("^(day|lunar-day|sexagenary-day|year-month-day)"), "day").when(c.rlike("^(month|lunar-month|year-month)"), "month").otherwise("year")


def precision_of(json: Column, side: str) -> Column:
    """The token of a field that is a string, plain or as JSON, or an object with start and end."""
    value = F.try_parse_json(json)
    plain = F.when(~json.startswith("{"), F.coalesce(F.try_variant_get(value, "$", "string"), json))
    return F.coalesce(F.try_variant_get(value, f"$.{side}", "string"), plain)


def clamp(date: Column, p: Column) -> Column:
    """Drop what is finer than the precision."""
    return F.when(date.isNotNull(), F.struct(date["y"].alias("y"), F.when(p != "year", date["m"]).alias("m"), F.when(p == "day", date["d"]).alias("d")))


def iso(date: Column) -> Column:
    """[-]YYYY[-MM[-DD]]."""
    pad = lambda x, n: F.lpad(F.abs(x).cast("string"), n, "0")
    year = F.concat(F.when(date["y"] < 0, "-").otherwise(""), pad(date["y"], 4))
    return F.concat(year, F.coalesce(F.concat(F.lit("-"), pad(date["m"], 2)), F.lit("")), F.coalesce(F.concat(F.lit("-"), pad(date["d"], 2)), F.lit("")))


def sort_key(date: Column) -> Column:
    """y * 10000 + m * 100 + d, unknown parts 0."""
    return date["y"].cast("long") * 10000 + F.coalesce(date["m"], F.lit(0)) * 100 + F.coalesce(date["d"], F.lit(0))


def depth(date: Column) -> Column:
    return F.when(date["d"].isNotNull() & date["m"].isNotNull(), 3).when(date["m"].isNotNull(), 2).otherwise(1)


def _once(a: Column, b: Column, f) -> Column:
    """f(a, b) of two dates that are computed once, however often f names them; their texts are long to parse."""
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: f(x["a"], x["b"])), F.lit(0))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 at the precision that both have."""

    def made(a: Column, b: Column) -> Column:
        to = F.least(depth(a), depth(b))
        part = lambda x, name, n: F.when(to >= n, x[name]).otherwise(0)
        key = lambda x: x["y"].cast("long") * 10000 + part(x, "m", 2) * 100 + part(x, "d", 3)
        return F.signum(key(a) - key(b)).cast("int")

    return _once(a, b, made)


def jdn(y: Column, m: Column, d: Column) -> Column:
    """The Julian day number of an astronomical year, month and day: Julian before 1582-10-15, else Gregorian. From year -4800 on."""
    div = lambda a, b: F.floor(a / b).cast("long")
    late = div(14 - m, 12)
    years, months = y + 4800 - late, m + 12 * late - 3
    days = d + div(153 * months + 2, 5) + 365 * years + div(years, 4)
    gregorian = y.cast("long") * 10000 + m * 100 + d >= 15821015
    return (days + F.when(gregorian, div(years, 400) - div(years, 100) - 32045).otherwise(-32083)).cast("long")


def exact_days(a: Column, b: Column) -> Column:
    """Days between two dates with day precision, else null."""
    known = lambda a, b: (depth(a) == 3) & (depth(b) == 3)
    return _once(a, b, lambda a, b: F.when(known(a, b), jdn(b["y"], b["m"], b["d"]) - jdn(a["y"], a["m"], a["d"])))


def counted_age(birth: Column, at: Column) -> Column:
    """The age that counts the year of birth as one; both years astronomical."""
    return at - birth + 1


def year_matches_date(year: Column, date: Column) -> Column:
    """Whether a historic year goes with a date: CE equal; BCE one more, or two up to February."""
    off = date["y"] - year
    return F.when(year > 0, off == 0).otherwise((off == 1) | ((off == 2) & (F.coalesce(date["m"], F.lit(12)) <= 2)))


def bce_convention(note: Column, date: Column, bce: str = r"前(\d+)年") -> Column:
    """Whether the date's year is -(n - 1), or -n as written, for some BCE year n of a note; null without one."""
    years = F.transform(F.regexp_extract_all(note, F.lit(bce), F.lit(1)), lambda x: x.cast("int"))
    return F.when(F.size(years) > 0, F.exists(years, lambda n: date["y"] == -(n - 1)))


#: Fixed value: an arrow or equals sign before a date with hyphens, or with the signs for year, month and day.
CLAIM = r"[→=]\s*(-?\d{3,4})[-年](\d{1,2})[-月](\d{1,2})日?"


def claims(c: Column, pattern: str = CLAIM) -> Column:
    """The dates that a text claims, as an array of struct(y, m, d)."""
    parts = [F.regexp_extract_all(c, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "ymd"))), lambda x: F.struct(*(x[n].cast("int").alias(n) for n in "ymd")))


def format_year(y: Column) -> Column:
    return F.when(y < 0, F.concat(F.lit("前"), (-y).cast("string"))).otherwise(y.cast("string"))


def period(a: Column, b: Column) -> Column:
    return F.concat(F.when(a == b, format_year(a)).otherwise(F.concat(format_year(a), F.lit("–"), format_year(b))), F.lit("年"))


def duration(days: Column) -> Column:
    """Years of 365 days and days, without the part that is 0; less than a day for 0."""
    years, rest = F.floor(days / 365).cast("long"), F.pmod(days, F.lit(365)).cast("long")
    some = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    return F.when(days <= 0, "1日未満").otherwise(F.concat(some(years, "年"), some(rest, "日")))


def display_years_fit(total_days: Column, shown: Column) -> Column:
    """Whether a figure is the total over 365 or 365.25, rounded half to even to 0, 1 or 2 places."""
    made = F.array(*(F.bround(total_days / n, places) for n in (365, 365.25) for places in (0, 1, 2)))
    return F.exists(made, lambda x: F.abs(x - shown) < 1e-9)
