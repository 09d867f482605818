"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut


EDGES_A_TASK = 100_000


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, root) for each node with an edge to another; root is the least node of its component.

    Self-loops and edges with a null end are ignored; no edges give no rows. Each round is a few
    grouped minima and equi-joins on edges, whose number never grows, and its result is checkpointed.
    Hubs are no special case: minima combine before the shuffle and the joins can be split. There are as
    many tasks as the edges need, however many partitions the session shuffles to, so that rounds over
    few edges don't leave hundreds of small files.
    """
    a, b = F.col(left), F.col(right)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    was, digest = None, _digest(now)
    tasks = -(-digest[0] // EDGES_A_TASK) or 1
    dealt = lambda df: df.coalesce(tasks)
    now = dealt(now)
    while digest != was:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = dealt(dealt(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))).distinct())
        least = dealt(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = dealt(large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        now = cut(dealt(small.union(least.select("hi", F.col("m").alias("lo"))).distinct()))
        was, digest = digest, _digest(now)
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
