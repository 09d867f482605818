"""Nations as a graph: each nation's customers order most from the suppliers of its partner."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sagaframe.operators import asserting, graph
from sagaframe.plans.registry import query, table

_TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM trade), edges AS (SELECT src, dst FROM ranked WHERE r <= {k})"""


def _partners(spark, sf, k):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    joined = lines.join(orders, "l_orderkey").join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), "c_custkey")
    trade = joined.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return trade.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where(F.col("r") <= k).select("src", "dst")


def _nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))


@query(f"WITH {_TRADE.format(k=1)} SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM edges)")
def graph_roots(spark, sf):
    return graph.roots(_nations(spark, sf), _partners(spark, sf, 1))


@query(f"WITH {_TRADE.format(k=3)} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, CAST(count(*) AS BIGINT) AS n FROM edges GROUP BY 1, 2")
def undirected_dedup(spark, sf):
    return graph.undirected(_partners(spark, sf, 3))


@query(f"WITH {_TRADE.format(k=3)} SELECT dst AS id FROM edges WHERE src = 7 AND dst <> 7 UNION SELECT src FROM edges WHERE dst = 7 AND src <> 7")
def one_hop(spark, sf):
    return graph.neighbours(_partners(spark, sf, 3), 7)


@query(f"WITH {_TRADE.format(k=3)} SELECT x.dst AS a, y.dst AS b, CAST(count(*) AS BIGINT) AS n FROM edges x JOIN edges y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2")
def common_parent(spark, sf):
    return graph.common_parents(_partners(spark, sf, 3))


@query(f"""WITH RECURSIVE {_TRADE.format(k=1)}, walk AS (SELECT src AS start, dst AS here, least(src, dst) AS least, 1 AS n FROM edges
  UNION ALL SELECT start, dst, least(least, dst), n + 1 FROM walk JOIN edges ON src = here WHERE n < 30 AND here <> start)
SELECT start AS id, min(least) AS least FROM walk WHERE here = start GROUP BY 1""")
def cycle_detect(spark, sf):
    return graph.cycles(_partners(spark, sf, 1))


@query(f"""WITH RECURSIVE {_TRADE.format(k=2)}, walk AS (SELECT src AS start, dst AS here, [src] AS path FROM edges WHERE dst >= src
  UNION ALL SELECT start, dst, list_append(path, here) FROM walk JOIN edges ON src = here WHERE here <> start AND dst >= start AND len(path) < 5 AND NOT list_contains(path, here))
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS n FROM walk WHERE here = start""")
def cycle_paths(spark, sf):
    return graph.cycle_paths(_partners(spark, sf, 2), 5).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("n"))


@query(f"SELECT dst AS id, 'partner' AS kind, CAST(count(*) AS BIGINT) AS n, 4 AS allowed FROM (WITH {_TRADE.format(k=3)} SELECT * FROM edges) GROUP BY 1 HAVING count(*) > 4")
def in_degree_limits(spark, sf):
    return graph.cardinality(_partners(spark, sf, 3).withColumn("kind", F.lit("partner")), {"partner": 4})


@query()
def relaxation_fixpoint(spark, sf):
    nations = _nations(spark, sf)
    ring = nations.select(F.col("id").alias("src"), ((F.col("id") + 1) % 25).alias("dst"))
    return graph.relax(nations.select("id", F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("value")), ring.union(_partners(spark, sf, 1)))


@query("""WITH scope AS (SELECT n_nationkey, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' OR n_nationkey IN (0, 1))
SELECT a.n_name AS buyer, b.n_name AS seller, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN scope a ON a.n_nationkey = c_nationkey JOIN scope b ON b.n_nationkey = s_nationkey GROUP BY 1, 2""")
def scoped_trade(spark, sf):
    """What the nations of a scope (a region, and two more by key) sell to each other; another number of nations, or one twice, fails."""
    regions = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    inside = table(spark, sf, "nation").join(regions, "n_regionkey").where((F.col("r_name") == "ASIA") | F.col("n_nationkey").isin(0, 1)).select("n_nationkey", "n_name")
    scope = asserting.unique(asserting.sized(inside, 7, "nations in scope"), ["n_nationkey"])
    named = lambda key, name: scope.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    buyers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(named("c_nationkey", "buyer"), "c_nationkey")
    sellers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(named("s_nationkey", "seller"), "s_nationkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(buyers, "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(sellers, "l_suppkey")
    return lines.join(orders, "l_orderkey").groupBy("buyer", "seller").agg(F.count("*").alias("n"))
