"""Ranks, top rows, neighbours and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.operators import matching, ranking
from sagaframe.plans.registry import query, table


def _orders_of(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return table(spark, sf, "customer").join(counts, "c_custkey", "left").withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))


_COUNTED = "counted AS (SELECT c_custkey, c_name, c_mktsegment, CAST(coalesce(n, 0) AS BIGINT) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


@query(f"""WITH {_COUNTED}, ranked AS (SELECT c_custkey, CAST(rank() OVER (ORDER BY n_orders DESC) AS BIGINT) AS rank, CAST(count(*) OVER () AS BIGINT) AS total,
  count(*) OVER (PARTITION BY n_orders) > 1 AS tied FROM counted WHERE n_orders > 0)
SELECT c.c_custkey, c.n_orders, r.rank, r.total, r.tied FROM counted c LEFT JOIN ranked r ON r.c_custkey = c.c_custkey""")
def rank_competition(spark, sf):
    return ranking.competition_rank(_orders_of(spark, sf), "n_orders", eligible=F.col("n_orders") > 0).select("c_custkey", "n_orders", "rank", "total", "tied")


@query("""SELECT p_partkey, CAST(rank() OVER (ORDER BY p_retailprice) AS BIGINT) AS rank, CAST(count(*) OVER () AS BIGINT) AS total,
  count(*) OVER (PARTITION BY p_retailprice) > 1 AS tied FROM part""")
def rank_ties_total(spark, sf):
    return ranking.competition_rank(table(spark, sf, "part"), "p_retailprice", descending=False).select("p_partkey", "rank", "total", "tied")


@query(f"WITH {_COUNTED} SELECT c_custkey, n_orders, CAST(rank() OVER (ORDER BY n_orders DESC) AS BIGINT) AS rank FROM counted WHERE c_mktsegment = 'BUILDING' AND n_orders > 0")
def rank_filtered_anchor(spark, sf):
    kept, _ = matching.ranked_filter(matching.optional_filters(_orders_of(spark, sf), c_mktsegment="BUILDING", c_nationkey="all"), "n_orders", True)
    return ranking.competition_rank(kept, "n_orders").select("c_custkey", "n_orders", "rank").orderBy("n_orders", "c_custkey")


@query("""SELECT n_name, floor(m + 0.5) / 100 AS mean, CAST(row_number() OVER (ORDER BY m DESC, n_nationkey) AS BIGINT) AS place
FROM (SELECT n_nationkey, n_name, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)""")
def row_rank_by_mean(spark, sf):
    cents = F.sum(F.round(F.col("c_acctbal") * 100).cast("long"))  # whole, so that the order of summing doesn't matter
    means = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((cents / F.count("*")).alias("m")).join(table(spark, sf, "nation"), "n_nationkey")
    return ranking.row_rank(means, "place", [F.desc("m"), F.asc("n_nationkey")], []).select("n_name", (F.floor(F.col("m") + 0.5) / 100).alias("mean"), "place")


@query("SELECT p_partkey, p_size, p_name FROM part ORDER BY p_size DESC, p_partkey LIMIT 10")
def topk_stable(spark, sf):
    return ranking.top_k(table(spark, sf, "part").select("p_partkey", "p_size", "p_name"), 10, F.desc("p_size"), F.asc("p_partkey"))


@query("""SELECT conv_id, turn, role, lag(role) OVER w AS prev_role, lead(role) OVER w AS next_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def prev_next(spark, sf):
    order = [F.asc(c) for c in ("turn", "role", "text")]
    return ranking.neighbours(table(spark, sf, "conversations"), "role", order, ["conv_id"]).select("conv_id", "turn", "role", "prev_role", "next_role")


@query(f"WITH {_COUNTED} SELECT c_custkey, c_name, n_orders FROM counted WHERE n_orders = (SELECT max(n_orders) FROM counted)")
def leaders_at_rank_one(spark, sf):
    return ranking.leaders(ranking.competition_rank(_orders_of(spark, sf), "n_orders")).select("c_custkey", "c_name", "n_orders")


@query(f"""WITH {_COUNTED}, best AS (SELECT c_mktsegment, max(n_orders) AS most FROM counted GROUP BY 1),
lead AS (SELECT c.c_mktsegment, most, count(*) AS k, min(c_name) AS a, max(c_name) AS z FROM counted c JOIN best b ON b.c_mktsegment = c.c_mktsegment AND n_orders = most GROUP BY 1, 2)
SELECT c_mktsegment, CASE WHEN k = 1 THEN a WHEN k = 2 THEN a || ' and ' || z ELSE a || ' and ' || CAST(k - 1 AS VARCHAR) || ' others' END
  || CASE WHEN k = 1 THEN ' leads with ' ELSE ' lead with ' END || CAST(most AS VARCHAR) || ' orders' AS sentence FROM lead""")
def takeaway_sentences(spark, sf):
    counted = _orders_of(spark, sf)
    best = counted.groupBy("c_mktsegment").agg(F.max("n_orders").alias("most"))
    lead = counted.join(best, "c_mktsegment").where("n_orders = most").groupBy("c_mktsegment", "most").agg(F.count("*").alias("k"), F.min("c_name").alias("a"), F.max("c_name").alias("z"))
    who = F.when(F.col("k") == 1, F.col("a")).when(F.col("k") == 2, F.concat("a", F.lit(" and "), "z")).otherwise(F.concat("a", F.lit(" and "), F.col("k") - 1, F.lit(" others")))
    return lead.select("c_mktsegment", F.concat(who, F.when(F.col("k") == 1, " leads with ").otherwise(" lead with "), "most", F.lit(" orders")).alias("sentence"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 48 OFFSET 88")
def page_window(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    start, end = ranking.viewport(2400, 480, customers.count())
    return ranking.page(customers, start, end, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("""SELECT d.doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY q NULLS LAST, d.doc_id) AS BIGINT) AS place
FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def nulls_last_events(spark, sf):
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return ranking.row_rank(table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left"), "place", [F.asc_nulls_last("q"), F.asc("doc_id")], ["lang"]).select("doc_id", "lang", "place")
