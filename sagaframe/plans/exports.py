"""Round trips through writers, and streams over files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sagaframe.session import shared_folder
from sagaframe.plans.registry import micros, query, table
from sagaframe.sources import sinks
from sagaframe.streaming import windows


def _shared(spark) -> str:
    """A new folder where the session's shared checkpoints go, or a temporary one where none is set."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def flat_export_roundtrip(spark, sf):
    flat = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    path = _shared(spark)
    sinks.csv(flat, path)
    return spark.read.schema(flat.schema).options(header=True, quote='"', escape='"', lineSep="\r\n").csv(path)


@query("SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet")
    return windows.drain(windows.counts(stream, "ts", ["event_type"]), _shared(spark)).select(F.floor(micros("start") / 3_600_000_000).alias("hour"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 7200000000 THEN 0 ELSE 1 END AS c FROM e),
g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, CAST(min(us) AS BIGINT) AS a, CAST(max(us) + 7200000000 AS BIGINT) AS b, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet")
    found = windows.drain(windows.sessions(stream, "ts", ["user_id"], "2 hours"), _shared(spark))
    return found.select("user_id", micros("start").alias("a"), micros("stop").alias("b"), "n")
