"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Sources in order of code points weigh 1, 2, 3, repeating. Their targets share all words by weight;
a target stops at ``max_epochs`` times its source and the excess goes to the others by weight until
none is above. Sorted by cap over weight the capped sources come first, so the level is found with
prefix sums. A source is repeated whole ``floor(target / size)`` times; the rest is a seeded prefix of
its documents in hash order, found through sums by hash bucket, so that only one bucket of a source
is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, words

HASH_BITS, BUCKET_BITS, BROADCAST_SOURCES = 60, 12, 10_000
_SHIFT = HASH_BITS - BUCKET_BITS


def _described(id_col: str, text_col: str, source_col: str, seed: str, sized: bool = True) -> list[Column]:
    source = F.col(source_col).cast("string")
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))), 1, HASH_BITS // 4), 16, 10).cast("long")
    made = [F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)).alias("_source"), hashed.alias("_hash")]
    return made + ([F.size(words(F.col(text_col))).cast("long").alias("_size")] if sized else [])


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(_source, source_size, target) from (_source, source_size): one row for each source, null as 'n', others after an 's'."""
    order = Window.orderBy(F.col("_source") == "n", "_source")
    listed = F.array(*map(F.lit, weights))
    weighed = sources.withColumn("place", F.row_number().over(order)).withColumn("w", F.get(listed, ((F.col("place") - 1) % len(weights)).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    rising = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    level = (
        weighed.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("shares", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rank", F.row_number().over(rising))
        .withColumn("fits", F.col("left") * F.col("w") <= F.col("cap") * F.col("shares"))
        .withColumn("at", F.min(F.when(F.col("fits"), F.struct("rank", "left", "shares"))).over(everything))
    )
    target = F.when(F.col("rank") < F.col("at.rank"), F.col("cap").cast("double")).otherwise(F.col("at.left") * F.col("w") / F.col("at.shares"))
    return level.select("_source", "source_size", target.alias("target"))


def plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(_source, source_size, target, _whole, _until) from (_source, _hash, _size): a document is taken
    _whole times, and once more if its _hash is below _until."""
    bucket = F.shiftright("_hash", _SHIFT)
    buckets = cut(sized.groupBy("_source", bucket.alias("bucket")).agg(F.sum("_size").alias("n")))
    filled = water_fill(buckets.groupBy("_source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = cut(filled.withColumn("_whole", whole).withColumn("need", F.col("target") - F.col("_whole") * F.col("source_size")))
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("bucket")) - F.col("n")
    crossed = buckets.withColumn("before", before).join(filled.select("_source", "need"), "_source").where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("n") > F.col("need")))
    inside = sized.withColumn("bucket", bucket).join(crossed.drop("n"), ["_source", "bucket"]).groupBy("_source", "bucket", "before", "need", "_hash").agg(F.sum("_size").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("_source").orderBy("_hash")) - F.col("n") + F.col("n") / 2
    beyond = inside.withColumn("upto", upto).groupBy("_source", "bucket").agg(F.min(F.when(F.col("upto") > F.col("need"), F.col("_hash"))).alias("first"))
    until = beyond.select("_source", F.coalesce("first", F.shiftleft(F.col("bucket") + 1, _SHIFT)).alias("_until"))
    # Without a bucket in which the need ends, it is all of the source.
    return cut(filled.drop("need").join(until, "_source", "left").withColumn("_until", F.coalesce("_until", F.lit(1 << HASH_BITS))))


def _with_plan(docs: DataFrame, planned: DataFrame) -> DataFrame:
    return docs.join(F.broadcast(planned) if planned.count() <= BROADCAST_SOURCES else planned, "_source")


def _times() -> Column:
    return F.col("_whole") + (F.col("_hash") < F.col("_until")).cast("long")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    Null and blank texts have size 0; a null source is a source of its own, after all others; where no
    text has a word all targets are 0. Rows are taken by the hash of id and text: rows that repeat an id, or
    have none, are taken apart unless they have the same text too, and then together. An empty table gives no rows. Columns other than id, text and source aren't read.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), *_described(id_col, text_col, source_col, seed)))
    made = _with_plan(sized, plan(sized, weights, max_epochs))
    return made.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _times()).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the same columns."""
    sized = cut(docs.select(*_described(id_col, text_col, source_col, seed)))
    tagged = docs.select(F.struct("*").alias("_row"), *_described(id_col, text_col, source_col, seed, sized=False))
    made = _with_plan(tagged, plan(sized, weights, max_epochs)).select("_row", _times().alias("_times")).where("_times > 0")
    return made.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select("_row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER (ORDER BY 3 * source_size / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares,
         row_number() OVER (ORDER BY 3 * source_size / w, place) AS rank
  FROM weighed),
chosen AS (SELECT rank AS at_rank, rest AS at_rest, shares AS at_shares FROM levels WHERE rest * w <= 3 * source_size * shares ORDER BY rank LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN rank < at_rank THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(at_rest * w AS DOUBLE) / at_shares END AS target
  FROM levels, chosen),
planned AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
hashes AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source, h),
placed AS (SELECT source, h, CAST(sum(n) OVER (PARTITION BY source ORDER BY h) AS BIGINT) - n + n / 2 AS upto FROM hashes)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, p.source_size, p.target,
       CAST(s.size * (p.whole + CASE WHEN q.upto <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
JOIN placed q ON s.source IS NOT DISTINCT FROM q.source AND s.h = q.h
"""
