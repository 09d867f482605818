"""Integrity, existence, sets and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.operators import matching
from sagaframe.plans.aggregations import PRIORITIES
from sagaframe.plans.registry import query, table


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def ri_orphans(spark, sf):
    return matching.orphans(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS has_label FROM documents")
def existence_flag(spark, sf):
    return matching.existence_flag(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "has_label")


@query("""WITH c AS (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS n, count(*) AS k FROM supplier GROUP BY 1)
SELECT coalesce(c.n, s.n) AS nation, CAST(coalesce(c.k, 0) AS BIGINT) AS n_curated, CAST(coalesce(s.k, 0) AS BIGINT) AS n_data,
CASE WHEN c.n IS NULL THEN 'missing' WHEN s.n IS NULL THEN 'stale' WHEN c.k > 1 THEN 'repeated' ELSE 'both' END AS status FROM c FULL JOIN s ON c.n = s.n""")
def full_reconcile(spark, sf):
    return matching.coverage(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")), "nation")


@query("""WITH c(p) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('6-NONE')), d AS (SELECT o_orderpriority AS p, count(*) AS k FROM orders GROUP BY 1)
SELECT coalesce(c.p, d.p) AS priority, CASE WHEN c.p IS NULL THEN 0 ELSE 1 END AS n_curated, CAST(coalesce(k, 0) AS BIGINT) AS n_data,
CASE WHEN c.p IS NULL THEN 'missing' WHEN d.p IS NULL THEN 'stale' ELSE 'both' END AS status FROM c FULL JOIN d ON c.p = d.p""")
def coverage_bijection(spark, sf):
    curated = spark.createDataFrame([(p,) for p in [*PRIORITIES[:4], "6-NONE"]], "priority string")
    found = matching.coverage(curated, table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority")), "priority")
    return found.withColumn("n_curated", F.col("n_curated").cast("int"))


@query("SELECT c_custkey, CAST(count(*) OVER (PARTITION BY c_nationkey) AS BIGINT) AS n_peers FROM customer")
def peer_count(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return customers.join(customers.groupBy("c_nationkey").agg(F.count("*").alias("n_peers")), "c_nationkey").select("c_custkey", "n_peers")


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal < 0), b AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS op, n FROM (SELECT n FROM a UNION SELECT n FROM b) UNION ALL SELECT 'except', n FROM (SELECT n FROM a EXCEPT SELECT n FROM b)
UNION ALL SELECT 'reverse', n FROM (SELECT n FROM b EXCEPT SELECT n FROM a) UNION ALL SELECT 'intersect', n FROM (SELECT n FROM a INTERSECT SELECT n FROM b)""")
def set_union_except_intersect(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("n"))
    b = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n"))
    parts = {"union": a.union(b).distinct(), "except": a.subtract(b), "reverse": b.subtract(a), "intersect": a.intersect(b)}
    named = [df.select(F.lit(op).alias("op"), "n") for op, df in parts.items()]
    return named[0].union(named[1]).union(named[2]).union(named[3])


@query("""SELECT l_returnflag, measure, CAST(count(*) AS BIGINT) AS n, round(sum(v), 2) AS total FROM (
SELECT l_returnflag, 'quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem
UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'tax', l_tax FROM lineitem) GROUP BY 1, 2""")
def unpivot_measures(spark, sf):
    long = table(spark, sf, "lineitem").selectExpr("l_returnflag", "stack(4, 'quantity', l_quantity, 'price', l_extendedprice, 'discount', l_discount, 'tax', l_tax) AS (measure, v)")
    return long.groupBy("l_returnflag", "measure").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'gone' ELSE coalesce(CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, source, 'none') END AS name
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def coalesce_chain(spark, sf):
    known = table(spark, sf, "documents").select("doc_id", "source", F.lit(True).alias("_there"))
    joined = table(spark, sf, "labels").join(known, "doc_id", "left")
    name = F.coalesce(F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, "toxic"), F.col("source"), F.lit("none"))
    return joined.select("doc_id", F.when(F.col("_there").isNull(), "gone").otherwise(name).alias("name"))


@query("""SELECT d.doc_id, CASE WHEN d.source <> '' AND l.q = 1 THEN d.source || '/' || d.lang END AS section FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id""")
def nullable_section(spark, sf):
    marks = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    joined = table(spark, sf, "documents").select("doc_id", "source", "lang").join(marks, "doc_id", "left")
    return joined.select("doc_id", F.when((F.col("source") != "") & (F.col("q") == 1), F.concat_ws("/", "source", "lang")).alias("section"))


@query("SELECT event_id, k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_map_explode(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")))


@query("""WITH now AS (SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id % 3 <> 0), known AS (SELECT doc_id AS key, CASE WHEN min(quality) = 0 THEN 'unresolved' ELSE 'cache' END AS status FROM labels GROUP BY 1)
SELECT coalesce(n.key, k.key) AS key, coalesce(status, 'pending') AS status, CASE WHEN n.key IS NULL THEN 'stale' WHEN status IS NULL THEN 'new' WHEN status = 'unresolved' THEN 'retry' ELSE 'known' END AS state
FROM now n FULL JOIN known k ON n.key = k.key""")
def ledger_diff(spark, sf):
    now = table(spark, sf, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("key")).distinct()
    known = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("key")).agg(F.when(F.min("quality") == 0, "unresolved").otherwise("cache").alias("status"))
    return matching.ledger(now, known, "key")
