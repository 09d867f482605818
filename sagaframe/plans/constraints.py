"""The rule suite on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagaframe.operators import quality
from sagaframe.plans.registry import query, table


def rules(spark, sf) -> list[quality.Rule]:
    lines, orders, events, docs = (table(spark, sf, t) for t in ("lineitem", "orders", "events", "documents"))

    def shipped_early():
        dated = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
        return quality.where(lines.select("l_orderkey", "l_shipdate").join(dated, "l_orderkey"), "l_orderkey", F.col("l_shipdate") < F.col("o_orderdate"), "shipped before it was ordered")

    def line_keys():
        return quality.unique(lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("k")), "k")

    return [
        quality.Rule("line key", "error", line_keys),
        quality.Rule("ship date", "error", shipped_early),
        quality.Rule("order status", "error", lambda: quality.vocabulary(orders, "o_orderkey", "o_orderstatus", ["O", "F"])),
        quality.Rule("event props", "error", lambda: quality.matches(events, "event_id", "props", r'^\{"k": [0-9]+\}$')),
        quality.Rule("char count", "error", lambda: quality.where(docs, "doc_id", F.length("text") != F.col("n_chars"), "n_chars is off")),
        quality.Rule("copy", "warning", lambda: quality.unique(docs.select(F.md5("text").alias("digest")), "digest")),
        quality.Rule("language", "warning", lambda: quality.vocabulary(docs, "doc_id", "lang", ["en", "de", "fr"]), ("-1",)),
    ]


@query("""WITH v AS (
SELECT 'line key' AS rule, 'error' AS severity FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'ship date', 'error' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'order status', 'error' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT 'event props', 'error' FROM events WHERE NOT coalesce(regexp_full_match(props, '\\{"k": [0-9]+\\}'), false)
UNION ALL SELECT 'char count', 'error' FROM documents WHERE length(text) <> n_chars
UNION ALL SELECT 'copy', 'warning' FROM (SELECT 1 FROM documents GROUP BY md5(text) HAVING count(*) > 1)
UNION ALL SELECT 'language', 'warning' FROM documents WHERE lang NOT IN ('en', 'de', 'fr')
UNION ALL SELECT 'language', 'warning')
SELECT rule, severity, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1, 2""")
def dq_summary(spark, sf):
    return quality.summary(quality.suite(rules(spark, sf)))
