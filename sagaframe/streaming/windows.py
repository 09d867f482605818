"""Interval and counting operators on unbounded input, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; what comes later than ``late`` is dropped and closed windows leave the state."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of activity that a pause of ``gap`` ends: merging of adjacent intervals, on a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *keys, "n")


def first_seen(units: DataFrame, time: str, key: str, late: str = "1 day") -> DataFrame:
    """Only units whose key hasn't come within ``late``: an incremental ledger."""
    return units.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """All that is there now, through the stream into Parquet under ``folder``, which all executors share.

    Each batch is written as a table of its own by the executors, again if it is repeated after a failure. In
    complete mode the last batch holds all rows, else they are those of all batches. Without any input there are no rows.
    """
    spark, rows = stream.sparkSession, f"{folder}/rows"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch-{n}")

    running = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(rows)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = sorted(int(s.getPath().getName().split("-")[1]) for s in files.listStatus(place)) if files.exists(place) else []
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{rows}/batch-{n}" for n in (batches[-1:] if mode == "complete" else batches)))
