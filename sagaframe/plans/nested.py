"""Queries over nested values: schemas at every level, and paths with wildcards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaframe.operators import paths, schemas
from sagaframe.plans.registry import query, table

#: An order with its lines; tax and comment aren't listed, so only the strict form minds them.
ORDER = {
    "type": "object", "required": ["id", "head", "lines"], "$defs": {"place": {"type": "object", "required": ["mode"], "properties": {"mode": {"enum": ["O A", "O R", "O N", "F A"]}, "flag": {"type": "string", "pattern": "^[AR]$"}}}},
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "head": {"type": "object", "properties": {"status": {"const": "O"}, "total": {"type": "number", "maximum": 400000}}},
        "lines": {"type": "array", "maxItems": 6, "items": {"type": "object", "required": ["no", "cut"], "properties": {"no": {"type": "integer"}, "quantity": {"type": "number", "exclusiveMaximum": 50}, "cut": {"type": "number"}, "place": {"$ref": "#/$defs/place"}}}},
    },
}


def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(id, head, lines): an order has few lines, so its array is bounded."""
    line = F.struct(F.col("l_linenumber").alias("no"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("cut"), F.when(F.col("l_linenumber") == 5, F.col("l_tax")).alias("tax"), F.struct(F.concat_ws(" ", "l_linestatus", "l_returnflag").alias("mode"), F.col("l_returnflag").alias("flag")).alias("place"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), head.alias("head")).join(lines, F.col("id") == F.col("l_orderkey")).select("id", "head", "lines")


_LINES = """l AS (SELECT l_orderkey AS id, l_linenumber AS no, l_quantity AS quantity, l_discount AS cut, l_tax AS tax, l_linestatus || ' ' || l_returnflag AS mode, l_returnflag AS flag,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, CASE WHEN l_linenumber = 5 THEN l_tax END, l_linestatus || ' ' || l_returnflag, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_RULES = """SELECT id, '$.lines' AS path, 'maxItems' AS rule FROM (SELECT DISTINCT id, n FROM l) WHERE n > 6
UNION ALL SELECT id, '$.lines[' || i || ']', 'required' FROM l WHERE cut = 0
UNION ALL SELECT id, '$.lines[' || i || '].quantity', 'exclusiveMaximum' FROM l WHERE quantity >= 50
UNION ALL SELECT id, '$.lines[' || i || '].place.mode', 'enum' FROM l WHERE mode NOT IN ('O A', 'O R', 'O N', 'F A')
UNION ALL SELECT id, '$.lines[' || i || '].place.flag', 'pattern' FROM l WHERE flag NOT IN ('A', 'R')
UNION ALL SELECT id, '$.head.status', 'const' FROM (SELECT DISTINCT id FROM l) JOIN orders ON o_orderkey = id WHERE o_orderstatus <> 'O'
UNION ALL SELECT id, '$.head.total', 'maximum' FROM (SELECT DISTINCT id FROM l) JOIN orders ON o_orderkey = id WHERE o_totalprice > 400000"""


@query(f"WITH {_LINES}, v AS ({_RULES}) SELECT CAST(id AS VARCHAR) AS key, path, rule FROM v")
def schema_violations(spark, sf):
    docs = nested_orders(spark, sf).select("id", F.struct("id", "head", "lines").alias("order"))
    return schemas.violations(docs, "order", "id", ORDER).select("key", "path", "rule")


@query(f"WITH {_LINES}, v AS ({_RULES} UNION ALL SELECT id, '$.lines[' || i || ']', 'additionalProperties' FROM l WHERE no = 5) SELECT CAST(id AS VARCHAR) AS key, path, rule FROM v")
def schema_violations_strict(spark, sf):
    docs = nested_orders(spark, sf).select("id", F.struct("id", "head", "lines").alias("order"))
    return schemas.violations(docs, "order", "id", ORDER, closed=True).select("key", "path", "rule")


@query(f"""WITH {_LINES}, w AS (SELECT id, i, unnest(string_split(mode, ' ')) AS value, generate_subscripts(string_split(mode, ' '), 1) - 1 AS j FROM l)
SELECT id, 'lines[' || i || '].mode#' || j AS path, value FROM w UNION ALL SELECT id, 'flag of ' || i, flag FROM l
UNION ALL SELECT id, 'status', o_orderstatus FROM (SELECT DISTINCT id FROM l) JOIN orders ON o_orderkey = id""")
def path_values(spark, sf):
    wanted = [paths.Path("lines[*].place.mode", "lines[{}].mode", lambda c: F.split(c, " "), numbered=True), paths.Path("lines[*].place.flag", "flag of {}"), paths.Path("head.status", "status")]
    return paths.values(nested_orders(spark, sf), "id", wanted)
