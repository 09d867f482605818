"""Merging, counting, clipping, packing and joining of intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.operators import asserting, intervals, lanes, matching
from sagaframe.plans.registry import SPANS, day, micros, query, spans, table

_ISLANDS = """f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY {k} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 0 ELSE 1 END AS c FROM {src}),
g AS (SELECT *, sum(c) OVER (PARTITION BY {k} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM f),
merged AS (SELECT {k}, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY {k}, i)"""
_DAYS = "days AS (SELECT DISTINCT user_id, epoch_us(ts) // 86400000000 AS a, epoch_us(ts) // 86400000000 AS b FROM events)"


def _hours(spark, sf, *keys):
    at = F.floor(micros("ts") / 3_600_000_000)
    return table(spark, sf, "events").select(*keys, at.alias("a"), at.alias("b")).distinct()


@query(f"WITH {_DAYS}, {_ISLANDS.format(k='user_id', gap=1, src='days')} SELECT * FROM merged")
def interval_merge(spark, sf):
    at = F.floor(micros("ts") / 86_400_000_000)
    return intervals.merge(table(spark, sf, "events").select("user_id", at.alias("a"), at.alias("b")).distinct(), ["user_id"])


@query(f"WITH {SPANS}, {_ISLANDS.format(k='o_custkey', gap=7, src='spans')} SELECT * FROM merged")
def interval_merge_gap(spark, sf):
    return intervals.merge(spans(spark, sf), ["o_custkey"], 7)


@query(f"""WITH {SPANS}, d AS (SELECT a AS x, 1 AS d FROM spans UNION ALL SELECT b + 1, -1 FROM spans), s AS (SELECT x, sum(d) AS d FROM d GROUP BY 1)
SELECT CAST(x AS BIGINT) AS "at", CAST(sum(d) OVER (ORDER BY x) AS BIGINT) AS n FROM s""")
def concurrency_sweep(spark, sf):
    return intervals.concurrency(spans(spark, sf))


@query("SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS at, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1")
def concurrency_distinct(spark, sf):
    return intervals.units(_hours(spark, sf, "user_id")).groupBy("at").agg(F.count_distinct("user_id").alias("n"))


@query(f"""WITH hours AS (SELECT DISTINCT event_type, epoch_us(ts) // 3600000000 AS a, epoch_us(ts) // 3600000000 AS b FROM events), {_ISLANDS.format(k='event_type', gap=1, src='hours')},
l AS (SELECT event_type, lag(b) OVER (PARTITION BY event_type ORDER BY a) + 1 AS x, a - 1 AS b FROM merged)
SELECT event_type, CAST(x AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM l WHERE x <= b""")
def vacancies(spark, sf):
    return intervals.gaps(intervals.merge(_hours(spark, sf, "event_type"), ["event_type"]), ["event_type"])


@query(f"""WITH {SPANS}, m AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS s),
months AS (SELECT strftime(s, '%Y-%m') AS month, date_diff('day', DATE '1970-01-01', CAST(s AS DATE)) AS ra, date_diff('day', DATE '1970-01-01', CAST(s + INTERVAL 1 MONTH AS DATE)) - 1 AS rb FROM m)
SELECT o_orderkey, month, CAST(greatest(a, ra) AS BIGINT) AS a2, CAST(least(b, rb) AS BIGINT) AS b2 FROM spans JOIN months ON ra <= b AND rb >= a""")
def interval_clip(spark, sf):
    first = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month")))
    starts = spark.range(1).select(first.alias("s"))
    months = starts.select(F.date_format("s", "yyyy-MM").alias("month"), F.unix_date("s").cast("long").alias("ra"), (F.unix_date(F.add_months("s", 1)) - 1).cast("long").alias("rb"))
    return matching.overlaps(spans(spark, sf), months, [], 30).select("o_orderkey", "month", F.greatest("a", "ra").alias("a2"), F.least("b", "rb").alias("b2"))


@query(f"""WITH {SPANS} SELECT s.o_custkey, CAST(count(*) AS BIGINT) AS n_inside, CAST(count(DISTINCT s.o_orderkey) AS BIGINT) AS n_spans FROM lineitem JOIN orders o ON o.o_orderkey = l_orderkey
JOIN spans s ON s.o_custkey = o.o_custkey AND date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) BETWEEN s.a AND s.b GROUP BY 1""")
def event_to_span(spark, sf):
    shipped = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), day("l_shipdate").alias("a"), day("l_shipdate").alias("b"))
    points = shipped.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").drop("o_orderkey")
    held = spans(spark, sf).withColumnsRenamed({"a": "ra", "b": "rb"})
    return matching.overlaps(points, held, ["o_custkey"], 30).groupBy("o_custkey").agg(F.count("*").alias("n_inside"), F.count_distinct("o_orderkey").alias("n_spans"))


@query(f"""WITH {SPANS}, y AS (SELECT date_diff('day', DATE '1970-01-01', make_date(CAST(y AS INTEGER), 1, 1)) AS c FROM (SELECT unnest(generate_series(1995, 2003)) AS y)),
p AS (SELECT o_orderkey, a AS pa, b FROM spans UNION ALL SELECT o_orderkey, c, b FROM spans JOIN y ON c > a AND c <= b)
SELECT o_orderkey, CAST(pa AS BIGINT) AS pa, CAST(coalesce(lead(pa) OVER (PARTITION BY o_orderkey ORDER BY pa) - 1, b) AS BIGINT) AS pb FROM p""")
def split_at_cuts(spark, sf):
    years = F.array(*(F.unix_date(F.lit(f"{y}-01-01").cast("date")).cast("long") for y in range(1995, 2004)))
    return intervals.cut(spans(spark, sf), years).select("o_orderkey", "pa", "pb")


@query(f"""WITH {SPANS}, named AS (SELECT r_name, a, b FROM spans JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
{_ISLANDS.format(k='r_name', gap=1, src='named')}
SELECT r_name, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(n) AS BIGINT) AS n_segments, min(a) AS a, max(b) AS b FROM merged GROUP BY 1""")
def stream_rollup(spark, sf):
    place = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    where = table(spark, sf, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    # equal spans of a region are one before its window, so that a region's rows are bounded by its days
    named = spans(spark, sf).join(where, "o_custkey").groupBy("r_name", "a", "b").agg(F.count("*").alias("k"))
    merged = intervals.merge(named, ["r_name"]).alias("m")
    kept = named.alias("s").join(merged, (F.col("s.r_name") == F.col("m.r_name")) & F.col("s.a").between(F.col("m.a"), F.col("m.b")))
    return kept.groupBy("m.r_name").agg(F.count_distinct("m.a").alias("n_spans"), F.sum("k").alias("n_segments"), F.min("m.a").alias("a"), F.max("m.b").alias("b"))


def _items(spark, sf):
    return spans(spark, sf).withColumnRenamed("o_orderkey", "id")


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {by}) AS k FROM {src})"
#: Packing as a recursion whose state is the list of the lanes' ends.
_PACKED = """packed AS (SELECT o_custkey, o_orderkey AS id, a, b, k, CAST(0 AS BIGINT) AS lane, [b] AS ends FROM o WHERE k = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.a, o.b, o.k, CASE WHEN p > 0 THEN p - 1 ELSE len(ends) END, CASE WHEN p > 0 THEN list_concat(list_append(ends[1:p - 1], o.b), ends[p + 1:]) ELSE list_append(ends, o.b) END
FROM (SELECT w.*, coalesce(list_position(list_transform(w.ends, lambda e: e {op} n.a), true), 0) AS p FROM packed w JOIN o n ON n.o_custkey = w.o_custkey AND n.k = w.k + 1) w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1)"""
_BY_START = _ORDERED.format(by="a, b DESC, o_orderkey", src="spans")


@query(f"WITH RECURSIVE {SPANS}, {_BY_START}, {_PACKED.format(op='<=')} SELECT o_custkey, id, a, b, lane FROM packed")
def lane_pack_touching(spark, sf):
    return lanes.pack(_items(spark, sf), ["o_custkey"])


@query(f"WITH RECURSIVE {SPANS}, {_BY_START}, {_PACKED.format(op='<')} SELECT o_custkey, id, a, b, lane FROM packed")
def lane_pack_strict(spark, sf):
    return lanes.pack(_items(spark, sf), ["o_custkey"], touching=False)


_BLOCKED = "blocked AS (SELECT o_orderkey, o_custkey * 2 + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS o_custkey, a, b FROM spans)"


@query(f"""WITH RECURSIVE {SPANS}, {_BLOCKED}, {_ORDERED.format(by="a, b DESC, o_orderkey", src="blocked")}, {_PACKED.format(op='<=')},
used AS (SELECT o_custkey AS u, max(lane) + 1 AS n FROM packed GROUP BY 1)
SELECT o_custkey // 2 AS o_custkey, CAST(o_custkey % 2 AS INTEGER) AS block, id, a, b, CAST(lane + coalesce(n, 0) AS BIGINT) AS lane FROM packed LEFT JOIN used ON o_custkey % 2 = 1 AND u = o_custkey - 1""")
def lane_blocks(spark, sf):
    """Every third order in the lanes of the first block, the others behind them."""
    return lanes.pack_blocks(_items(spark, sf).withColumn("block", (F.col("id") % 3 != 0).cast("int")), ["o_custkey"], "block")


@query(f"""WITH {SPANS}, {_ISLANDS.format(k='o_custkey', gap=7, src='spans')}
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY a) - 1 AS BIGINT) AS place, a, b FROM merged""")
def positional_rows(spark, sf):
    """Each merged span of a customer with the row that a list gives it by its place; a list of another length fails."""
    merged = intervals.merge(spans(spark, sf), ["o_custkey"], 7)
    # a customer's merged spans lie apart, so they are fewer than the calendar has days
    listed = merged.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"), F.count("*").alias("n"))
    rows = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    each = listed.select("o_custkey", F.explode(asserting.zipped(F.col("spans"), rows, "rows of spans")).alias("_e"))
    return each.select("o_custkey", F.col("_e.right").alias("place"), F.col("_e.left.a").alias("a"), F.col("_e.left.b").alias("b"))


@query(f"""WITH RECURSIVE {SPANS}, {_ORDERED.format(by="o_orderkey % 7, o_orderkey", src="spans")},
w AS (SELECT o_custkey, o_orderkey AS id, a, b, k, CAST(0 AS BIGINT) AS lane, [{{'a': a, 'b': b, 'lane': CAST(0 AS BIGINT)}}] AS placed FROM o WHERE k = 1
UNION ALL SELECT o_custkey, id, a, b, k, lane, list_append(placed, {{'a': a, 'b': b, 'lane': lane}}) FROM (
  SELECT o.o_custkey, o.o_orderkey AS id, o.a, o.b, o.k, w.placed,
         list_filter(generate_series(CAST(0 AS BIGINT), len(w.placed)), lambda x: NOT list_contains(list_transform(list_filter(w.placed, lambda r: r.b > o.a AND r.a < o.b), lambda r: r.lane), x))[1] AS lane
  FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1))
SELECT o_custkey, id, a, b, lane FROM w""")
def lane_first_fit(spark, sf):
    return lanes.first_fit(_items(spark, sf).withColumn("priority", F.col("id") % 7), ["o_custkey"], "priority")


@query(f"""WITH RECURSIVE {SPANS}, {_BY_START}, {_PACKED.format(op='<=')},
w AS (SELECT o_custkey, id, a, b, k, lane, CAST(1 AS BIGINT) AS slot, [{{'a': a, 'b': b, 'lane': lane, 'slot': CAST(1 AS BIGINT)}}] AS placed FROM packed WHERE k = 1
UNION ALL SELECT o_custkey, id, a, b, k, lane, slot, list_append(placed, {{'a': a, 'b': b, 'lane': lane, 'slot': slot}}) FROM (
  SELECT p.o_custkey, p.id, p.a, p.b, p.k, p.lane, w.placed,
         coalesce(list_filter(generate_series(CAST(1 AS BIGINT), CAST(8 AS BIGINT)), lambda x: NOT list_contains(list_transform(list_filter(w.placed, lambda r: r.b >= p.a AND r.a <= p.b), lambda r: r.slot), x)
           AND x IS DISTINCT FROM list_filter(w.placed, lambda r: r.lane = p.lane)[-1].slot)[1], p.lane % 8 + 1) AS slot
  FROM w JOIN packed p ON p.o_custkey = w.o_custkey AND p.k = w.k + 1))
SELECT o_custkey, id, a, b, slot FROM w""")
def slot_colouring(spark, sf):
    return lanes.colour(lanes.pack(_items(spark, sf), ["o_custkey"]), ["o_custkey"])


@query(f"""WITH RECURSIVE {SPANS}, {_ORDERED.format(by="a, b, o_orderkey", src="spans")},
w AS (SELECT o_custkey, o_orderkey AS id, a, b, k, CAST(a AS DOUBLE) AS start, CASE WHEN b > a THEN CAST(b AS DOUBLE) ELSE a + 0.5 END AS stop FROM o WHERE k = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.a, o.b, o.k, greatest(CAST(o.a AS DOUBLE), w.stop), CASE WHEN o.b > greatest(CAST(o.a AS DOUBLE), w.stop) THEN CAST(o.b AS DOUBLE) ELSE greatest(CAST(o.a AS DOUBLE), w.stop) + 0.5 END
FROM w JOIN o ON o.o_custkey = w.o_custkey AND o.k = w.k + 1)
SELECT o_custkey, id, a, b, start, stop FROM w""")
def running_cursor(spark, sf):
    return lanes.cursor(_items(spark, sf), ["o_custkey"])


def _pairs(spark, sf, closed):
    left = spans(spark, sf)
    right = left.select("o_custkey", F.col("o_orderkey").alias("r_orderkey"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    return matching.overlaps(left, right, ["o_custkey"], 30, closed).where("o_orderkey < r_orderkey").select("o_custkey", "o_orderkey", "r_orderkey")


@query(f"WITH {SPANS} SELECT l.o_custkey, l.o_orderkey, r.o_orderkey AS r_orderkey FROM spans l JOIN spans r ON l.o_custkey = r.o_custkey AND l.o_orderkey < r.o_orderkey AND r.a <= l.b AND r.b >= l.a")
def overlap_pairs(spark, sf):
    return _pairs(spark, sf, True)


@query(f"WITH {SPANS} SELECT l.o_custkey, l.o_orderkey, r.o_orderkey AS r_orderkey FROM spans l JOIN spans r ON l.o_custkey = r.o_custkey AND l.o_orderkey < r.o_orderkey AND r.a < l.b AND r.b > l.a")
def overlap_open(spark, sf):
    return _pairs(spark, sf, False)


@query(f"""WITH {SPANS}, n AS (SELECT *, lead(o_orderkey) OVER w AS next_order, lead(a) OVER w AS next_a FROM spans WINDOW w AS (PARTITION BY o_custkey ORDER BY a, b, o_orderkey))
SELECT o_custkey, o_orderkey, next_order, CAST(b - next_a AS BIGINT) AS days FROM n WHERE next_a <= b""")
def adjacent_overlap(spark, sf):
    from sagaframe.operators.ranking import neighbours

    order = [F.asc("a"), F.asc("b"), F.asc("o_orderkey")]
    both = neighbours(spans(spark, sf).withColumn("it", F.struct("o_orderkey", "a")), "it", order, ["o_custkey"])
    return both.where("next_it.a <= b").select("o_custkey", "o_orderkey", F.col("next_it.o_orderkey").alias("next_order"), (F.col("b") - F.col("next_it.a")).alias("days"))


def _minutes(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", F.floor(micros("ts") / 60_000_000).alias("at"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS at FROM events)
SELECT l.user_id, l.event_id, r.event_id AS r_event_id, CAST(abs(l.at - r.at) AS BIGINT) AS minutes FROM e l JOIN e r ON l.user_id = r.user_id AND l.event_id < r.event_id AND abs(l.at - r.at) <= 3""")
def band_join_minutes(spark, sf):
    left = _minutes(spark, sf)
    right = left.select("user_id", F.col("event_id").alias("r_event_id"), F.col("at").alias("r_at"))
    return matching.near(left, right, "at", "r_at", ["user_id"], 3).where("event_id < r_event_id").select("user_id", "event_id", "r_event_id", F.abs(F.col("at") - F.col("r_at")).alias("minutes"))


_SIDES = "l AS (SELECT user_id, event_id, epoch_us(ts) AS at FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, event_id AS seen, epoch_us(ts) AS at FROM events WHERE event_type = 'click')"


def _sides(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", micros("ts").alias("at"))
    return events.where("event_type = 'purchase'").drop("event_type"), events.where("event_type = 'click'").select("user_id", "at", F.col("event_id").alias("seen"))


@query(f"""WITH {_SIDES}, j AS (SELECT l.user_id, l.event_id, r.seen, row_number() OVER (PARTITION BY l.event_id ORDER BY r.at DESC NULLS LAST, r.seen DESC) AS k
FROM l LEFT JOIN r ON r.user_id = l.user_id AND r.at <= l.at) SELECT user_id, event_id, seen FROM j WHERE k = 1""")
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return matching.asof(left, right, ["user_id"], "at", ["seen"]).select("user_id", "event_id", "seen")


@query(f"""WITH {_SIDES}, j AS (SELECT l.user_id, l.event_id, r.at AS near_at, abs(r.at - l.at) AS d, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.at - l.at) NULLS LAST, r.at) AS k
FROM l LEFT JOIN r ON r.user_id = l.user_id) SELECT user_id, event_id, CAST(near_at AS BIGINT) AS near_at, CAST(d AS BIGINT) AS distance FROM j WHERE k = 1""")
def nearest_event(spark, sf):
    left, right = _sides(spark, sf)
    return matching.nearest(left, right, ["user_id"], "at", ["seen"]).select("user_id", "event_id", "near_at", F.abs(F.col("near_at") - F.col("at")).alias("distance"))


@query(f"""WITH {SPANS}, p AS (SELECT o_orderkey AS point, o_custkey, a + 45 + o_orderkey % 90 AS t FROM spans),
j AS (SELECT p.*, s.a, s.b, s.o_orderkey, greatest(s.a - t, t - s.b, 0) AS d FROM p JOIN spans s ON s.o_custkey = p.o_custkey),
k AS (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, a, b, o_orderkey) AS r FROM j)
SELECT point, o_orderkey AS nearest, CAST(d AS BIGINT) AS distance FROM k WHERE r = 1""")
def nearest_span(spark, sf):
    rows = spans(spark, sf)
    points = rows.select(F.col("o_orderkey").alias("point"), "o_custkey", (F.col("a") + 45 + F.col("o_orderkey") % 90).alias("at"))
    return matching.nearest_span(points, rows, ["o_custkey"], "at", ["o_orderkey"]).select("point", F.col("near_o_orderkey").alias("nearest"), "distance")


@query("""SELECT o_orderkey, s_name FROM orders LEFT JOIN supplier ON o_orderkey BETWEEN s_suppkey * 60 AND s_suppkey * 60 + 39""")
def points_in_ranges(spark, sf):
    start = (F.col("s_suppkey") * 60).cast("long")
    ranges = table(spark, sf, "supplier").select("s_name", start.alias("a"), (start + 39).alias("b"))
    return matching.in_ranges(table(spark, sf, "orders").select("o_orderkey"), ranges, "o_orderkey", ["s_name"])


@query("""WITH y AS (SELECT o_custkey, min(year(o_orderdate)) - 1 AS lo, max(year(o_orderdate)) + 1 AS hi FROM orders GROUP BY 1)
SELECT o.o_custkey, CAST(count(*) AS BIGINT) AS n_outside FROM lineitem JOIN orders o ON o_orderkey = l_orderkey JOIN y ON y.o_custkey = o.o_custkey WHERE NOT (year(l_shipdate) BETWEEN lo AND hi) GROUP BY 1""")
def range_containment(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    bounds = orders.groupBy("o_custkey").agg((F.min("y") - 1).alias("lo"), (F.max("y") + 1).alias("hi"))
    shipped = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.year("l_shipdate").alias("ship")).join(orders.drop("y"), "o_orderkey")
    return shipped.join(bounds, "o_custkey").where(~F.col("ship").between(F.col("lo"), F.col("hi"))).groupBy("o_custkey").agg(F.count("*").alias("n_outside"))


@query(f"""WITH {SPANS}, {_ISLANDS.format(k='o_custkey', gap=7, src='spans')},
p AS (SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, o_custkey, CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT line, max(m.a) FILTER (WHERE m.a <= t) AS latest, min(m.a) AS first FROM p JOIN merged m ON m.o_custkey = p.o_custkey GROUP BY line)
SELECT l_orderkey, l_linenumber, p.o_custkey, t AS "at", t <= m.b AS inside, coalesce(latest, first) AS begun
FROM p JOIN x ON x.line = p.line LEFT JOIN merged m ON m.o_custkey = p.o_custkey AND m.a = latest""")
def span_at(spark, sf):
    """The merged span of the same customer that holds each shipping day, else the latest begun, else the first."""
    merged = intervals.merge(spans(spark, sf), ["o_custkey"], 7)
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    points = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", day("l_shipdate").alias("at")).join(orders, "l_orderkey")
    return matching.containing_else_latest(points, merged.withColumn("begun", F.col("a")), ["o_custkey"], "at", ["begun"])
