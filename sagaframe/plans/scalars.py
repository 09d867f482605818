"""Dates, calendars and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.functions import dates
from sagaframe.plans.registry import SPANS, day, query, spans, table

_CUT = """cut AS (SELECT o_orderkey, substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 7 ELSE 10 END) AS s FROM orders),
parts AS (SELECT o_orderkey, s, CAST(substr(s, 1, 4) AS INTEGER) AS y, TRY_CAST(substr(s, 6, 2) AS INTEGER) AS m, TRY_CAST(substr(s, 9, 2) AS INTEGER) AS d FROM cut)"""


def _cut(spark, sf):
    n = F.when(F.col("o_orderkey") % 3 == 0, 4).when(F.col("o_orderkey") % 3 == 1, 7).otherwise(10)
    return table(spark, sf, "orders").select("o_orderkey", F.substring(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit(1), n).alias("s"))


@query(f"WITH {_CUT} SELECT o_orderkey, s, y, m, d, 1 + CAST(m IS NOT NULL AS INTEGER) + CAST(d IS NOT NULL AS INTEGER) AS depth FROM parts")
def partial_date_parse(spark, sf):
    return _cut(spark, sf).withColumn("p", dates.parse_strict(F.col("s"))).select("o_orderkey", "s", "p.*", dates.depth(F.col("p")).alias("depth"))


@query(f"""WITH {_CUT} SELECT o_orderkey, CASE WHEN m IS NULL OR o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN substr(s, 1, 4) WHEN d IS NULL OR o_orderkey % 2 = 0 THEN substr(s, 1, 7) ELSE s END AS iso,
CAST(y * 10000 + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 THEN 0 ELSE coalesce(m, 0) END * 100 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE coalesce(d, 0) END AS BIGINT) AS sort_key FROM parts""")
def date_clamp_sortkey(spark, sf):
    token = F.when(F.col("o_orderkey") % 10 == 0, "circa").when(F.col("o_orderkey") % 2 == 0, "lunar-month").otherwise("sexagenary-day")
    clamped = _cut(spark, sf).withColumn("p", dates.clamp(dates.parse_loose(F.col("s")), dates.precision(token)))
    return clamped.select("o_orderkey", dates.iso(F.col("p")).alias("iso"), dates.sort_key(F.col("p")).alias("sort_key"))


@query(f"""WITH {_CUT}, t AS (SELECT *, CASE WHEN m IS NULL THEN 1 WHEN d IS NULL THEN 2 ELSE 3 END AS depth FROM parts)
SELECT o_orderkey, CAST(CASE depth WHEN 1 THEN sign(y - 1998) WHEN 2 THEN sign(y * 100 + m - 199806) ELSE sign(y * 10000 + m * 100 + d - 19980615) END AS INTEGER) AS cmp FROM t""")
def cmp_truncated(spark, sf):
    return _cut(spark, sf).select("o_orderkey", dates.compare(dates.parse_strict(F.col("s")), dates.parse_strict(F.lit("1998-06-15"))).alias("cmp"))


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS BIGINT) AS jdn FROM orders")
def jdn_gregorian(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", dates.jdn(F.year(d), F.month(d), F.dayofmonth(d)).alias("jdn"))


@query("""WITH p AS (SELECT o_orderkey, CAST(1482 + o_orderkey % 200 AS BIGINT) AS y, CAST(1 + o_orderkey % 12 AS BIGINT) AS m, CAST(1 + o_orderkey % 28 AS BIGINT) AS d FROM orders),
q AS (SELECT *, (14 - m) // 12 AS l FROM p), r AS (SELECT *, y + 4800 - l AS yy, m + 12 * l - 3 AS mm FROM q)
SELECT o_orderkey, CAST(d + (153 * mm + 2) // 5 + 365 * yy + yy // 4 + CASE WHEN y * 10000 + m * 100 + d >= 15821015 THEN yy // 400 - yy // 100 - 32045 ELSE -32083 END AS BIGINT) AS jdn FROM r""")
def jdn_julian_cutover(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", dates.jdn(1482 + k % 200, 1 + k % 12, 1 + k % 28).alias("jdn"))


@query("SELECT l_orderkey, CAST(sum(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS BIGINT) AS days FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def exact_days(spark, sf):
    text = lambda c: dates.parse_strict(F.date_format(F.col(c).cast("date"), "yyyy-MM-dd"))
    joined = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), text("o_orderdate").alias("ordered")), "l_orderkey")
    return joined.groupBy("l_orderkey").agg(F.sum(dates.exact_days(F.col("ordered"), text("l_shipdate"))).alias("days"))


@query("""WITH y AS (SELECT o_orderkey, CAST(o_orderkey % 400 - 200 AS BIGINT) AS y FROM orders WHERE o_orderkey % 400 <> 200)
SELECT o_orderkey, y, CASE WHEN y < 0 THEN y + 1 ELSE y END AS astro, y AS back, CASE WHEN y < 0 THEN '前' || CAST(-y AS VARCHAR) ELSE CAST(y AS VARCHAR) END AS shown FROM y""")
def astro_year_roundtrip(spark, sf):
    years = table(spark, sf, "orders").where("o_orderkey % 400 <> 200").select("o_orderkey", (F.col("o_orderkey") % 400 - 200).alias("y"))
    astro = dates.astronomical(F.col("y"))
    return years.select("o_orderkey", "y", astro.alias("astro"), dates.historic(astro).alias("back"), dates.format_year(F.col("y")).alias("shown"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - (1940 + o_custkey % 40) + 1 AS BIGINT) AS age, abs(year(o_orderdate) - (1940 + o_custkey % 40) + 1 - (20 + o_orderkey % 60)) >= 2 AS off FROM orders""")
def counted_age(spark, sf):
    age = dates.counted_age(1940 + F.col("o_custkey") % 40, F.year("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", age.cast("long").alias("age"), (F.abs(age - (20 + F.col("o_orderkey") % 60)) >= 2).alias("off"))


@query(f"""WITH {SPANS}, l AS (SELECT o_custkey, CAST(sum(b - a) AS BIGINT) AS days FROM spans GROUP BY 1)
SELECT o_custkey, days, CASE WHEN days <= 0 THEN '1日未満' ELSE CASE WHEN days // 365 > 0 THEN CAST(days // 365 AS VARCHAR) || '年' ELSE '' END || CASE WHEN days % 365 > 0 THEN CAST(days % 365 AS VARCHAR) || '日' ELSE '' END END AS shown FROM l""")
def duration_format(spark, sf):
    lengths = spans(spark, sf).groupBy("o_custkey").agg(F.sum(F.col("b") - F.col("a")).alias("days"))
    return lengths.withColumn("shown", dates.duration(F.col("days")))


@query("""SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE CAST(min(year(o_orderdate)) AS VARCHAR) || '–' || CAST(max(year(o_orderdate)) AS VARCHAR) END || '年' AS period FROM orders GROUP BY 1""")
def period_label(spark, sf):
    years = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return years.select("o_custkey", dates.period(F.col("a"), F.col("b")).alias("period"))


@query("""SELECT o_orderkey FROM orders WHERE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) % 365 < 3""")
def near_new_year(spark, sf):
    return table(spark, sf, "orders").where(day("o_orderdate") % 365 < 3).select("o_orderkey")
