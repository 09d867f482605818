"""Profiles, distributions, runs, duplicates and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.operators import aggregates, intervals
from sagaframe.plans.registry import SPANS, micros, query, spans, table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_LISTED = ", ".join(f"('{p}', {i})" for i, p in enumerate(PRIORITIES))


def _customer_orders(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")


@query(f"""WITH j AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
best AS (SELECT c_nationkey, o_orderkey FROM (SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM j) WHERE r = 1)
SELECT j.c_nationkey, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 2) AS mean, any_value(best.o_orderkey) AS longest,
{", ".join(f"CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS BIGINT) AS n_{i}" for i, p in enumerate(PRIORITIES))}, min(j.o_orderkey) AS first_place
FROM j JOIN best ON best.c_nationkey = j.c_nationkey GROUP BY 1""")
def group_profile(spark, sf):
    return aggregates.group_profile(_customer_orders(spark, sf), "c_nationkey", "o_totalprice", "o_orderkey", "o_orderkey", "o_orderpriority", PRIORITIES).withColumn("mean", F.round("mean", 2))


@query("""WITH m AS (SELECT o_orderpriority AS mode, CAST(count(*) AS BIGINT) AS mode_n FROM orders GROUP BY 1 ORDER BY mode_n DESC, min(o_orderkey) LIMIT 1)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 2) AS mean, (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS largest,
(SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) AS least, (SELECT mode FROM m) AS mode, (SELECT mode_n FROM m) AS mode_n,
CAST(floor(100 * (SELECT mode_n FROM m) / count(*) + 0.5) AS BIGINT) AS mode_percent FROM orders""")
def overview_stats(spark, sf):
    return aggregates.overview(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", "o_orderkey", "o_orderpriority").withColumn("mean", F.round("mean", 2))


@query(f"""SELECT c_nationkey, {", ".join(f"CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS BIGINT) AS n_{i}" for i, p in enumerate(PRIORITIES))}, CAST(count(*) AS BIGINT) AS n,
{", ".join(f"CAST(floor(100 * count(*) FILTER (WHERE o_orderpriority = '{p}') / count(*) + 0.5) AS BIGINT) AS p_{i}" for i, p in enumerate(PRIORITIES))}
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def group_category_pivot(spark, sf):
    return aggregates.pivot_shares(_customer_orders(spark, sf), "c_nationkey", "o_orderpriority", PRIORITIES)


@query(f"""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(pos AS BIGINT) AS pos, CAST(floor(100 * count(*) / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent
FROM orders JOIN (VALUES {_LISTED}) v(p, pos) ON p = o_orderpriority GROUP BY 1, pos""")
def category_distribution(spark, sf):
    return aggregates.distribution(table(spark, sf, "orders"), "o_orderpriority", PRIORITIES).select("o_orderpriority", "n", "pos", "percent")


@query("SELECT p_name, CAST(count(DISTINCT p_brand) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def ambiguous_keys(spark, sf):
    return aggregates.ambiguous(table(spark, sf, "part"), "p_name", "p_brand")


@query(f"""WITH {SPANS} SELECT o_custkey, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b,
strftime(DATE '1970-01-01' + CAST(min(a) AS INTEGER), '%Y-%m-%d') || '/' || strftime(DATE '1970-01-01' + CAST(max(b) AS INTEGER), '%Y-%m-%d') AS extent FROM spans GROUP BY 1""")
def envelope_by_key(spark, sf):
    text = lambda c: F.date_format(F.date_from_unix_date(F.col(c).cast("int")), "yyyy-MM-dd")
    return spans(spark, sf).groupBy("o_custkey").agg(F.min("a").alias("a"), F.max("b").alias("b")).withColumn("extent", F.concat(text("a"), F.lit("/"), text("b")))


@query(f"""WITH {SPANS} SELECT s.o_custkey, string_agg(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR), ' ' ORDER BY a, b, s.o_orderkey) AS segments, CAST(count(DISTINCT o_orderstatus) AS BIGINT) AS n_status,
min(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) AS priority FROM spans s JOIN orders o ON o.o_orderkey = s.o_orderkey GROUP BY 1""")
def collect_ordered_segments(spark, sf):
    joined = spans(spark, sf).join(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("a", "b", "o_orderkey"))), lambda x: F.concat_ws("-", x["a"], x["b"]))
    priority = F.min(F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2))
    return joined.groupBy("o_custkey").agg(F.array_join(listed, " ").alias("segments"), F.count_distinct("o_orderstatus").alias("n_status"), priority.alias("priority"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def facet_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first FROM events GROUP BY 1")
def pool_first_appearance(spark, sf):
    return aggregates.pool(table(spark, sf, "events"), "event_type", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us, event_id FROM events),
f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY us, event_id) AS BIGINT) AS run FROM f)
SELECT user_id, run, event_type, min(us) AS first, max(us) AS last, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2, 3""")
def run_grouping(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", micros("ts").alias("us"), "event_id")
    return aggregates.runs(events, ["user_id"], ["us", "event_id"], "event_type")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(DISTINCT user_id) AS u FROM events GROUP BY 1, 2),
ends AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM e GROUP BY 1),
spine AS (SELECT event_type, unnest(generate_series(lo, hi)) AS hour FROM ends),
s AS (SELECT s.event_type, s.hour, CASE WHEN u IS NULL THEN 'vacant' WHEN u = 1 THEN 'sole' ELSE 'split' END AS state FROM spine s LEFT JOIN e ON e.event_type = s.event_type AND e.hour = s.hour),
f AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER w THEN 1 ELSE 0 END AS c FROM s WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
g AS (SELECT *, CAST(sum(c) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS run FROM f)
SELECT event_type, run, state, CAST(min(hour) AS BIGINT) AS first, CAST(max(hour) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1, 2, 3""")
def run_length_states(spark, sf):
    hours = table(spark, sf, "events").select("event_type", F.floor(micros("ts") / 3_600_000_000).alias("at"), "user_id").groupBy("event_type", "at").agg(F.count_distinct("user_id").alias("u"))
    spine = hours.groupBy("event_type").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    state = F.when(F.col("u").isNull(), "vacant").when(F.col("u") == 1, "sole").otherwise("split")
    states = intervals.units(spine).select("event_type", "at").join(hours, ["event_type", "at"], "left").withColumn("state", state)
    return aggregates.runs(states, ["event_type"], ["at"], "state")


@query("""SELECT 'lineitem' AS kind, CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'documents', md5(text), CAST(count(*) AS BIGINT) FROM documents GROUP BY md5(text) HAVING count(*) > 1""")
def dup_detection(spark, sf):
    lines = aggregates.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select(F.lit("lineitem").alias("kind"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "n")
    return lines.union(aggregates.duplicates(table(spark, sf, "documents"), F.md5("text").alias("key")).select(F.lit("documents"), "key", "n"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS n_returned,
CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS n_open FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 2""")
def cardinality_limits(spark, sf):
    c = lambda column, v, name: aggregates.count_if(F.col(column) == v).alias(name)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), c("l_returnflag", "R", "n_returned"), c("l_linestatus", "O", "n_open")).where("n_returned > 2")


@query("""SELECT o_orderkey, o_totalprice AS stored, round(coalesce(s, 0), 2) AS recomputed, CAST(coalesce(n, 0) AS BIGINT) AS n_parts
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 0.01""")
def summary_reconcile(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return aggregates.reconcile(table(spark, sf, "orders"), parts, "o_orderkey", "o_totalprice", "l_extendedprice", 0.01).withColumn("recomputed", F.round("recomputed", 2))
