"""Pairs of similar sets in a group around one set, found by how each differs from it.

Sets near one lead have most of their elements in common, so that no rare element tells them apart and every pair
is a candidate. Their differences from the lead (what they lack and what they have besides) tell them apart: of two
sets with d and e differences, o of them shared, d + e - 2 * o elements differ. Let a pair be similar if at most
c = (100 - percent) / (100 + percent) of the sum of its sizes differ, which is a Jaccard index of ``percent`` or more.

*Outside*: sets that are similar to the lead are linked with it already, so one of each further pair isn't; it
has over c * (its size + the lead's) differences. *Prefix*: then over half as many as the other's differences have to be
shared, less or more by how the other's size departs from the lead's. So the rarest of the other's differences, all but
as many as have to be shared less one, hold one that the outside set has too. *Places*: the rarest shared one
stands so far before the end of both that enough can follow. None of these leaves out a similar pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.llm.common import cut


def similar(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst), src < dst, among the nodes of groups (lead, node, root) that may be similar, without those in one root.

    ``sets`` has (node, shingles) of nodes and leads. A pair of sets in a group with a Jaccard index of ``percent``
    or more is among the pairs unless it has one root or both are similar to the lead.
    """
    own, leads = sets.select("node", F.col("shingles").alias("own")), sets.select(F.col("node").alias("lead"), F.col("shingles").alias("whole"))
    each = groups.join(own, "node").join(leads, "lead").select("lead", "node", "root", F.size("own").alias("size"), F.size("whole").alias("around"), F.concat(F.array_except("own", "whole"), F.array_except("whole", "own")).alias("differs"))
    differ, twice = F.size("differs"), 2 * (100 + percent)
    outside = (100 + percent) * differ > (100 - percent) * (F.col("size") + F.col("around"))
    # The last place in order of rarity where the first difference may stand that is shared with a set outside.
    last = differ - F.floor(((100 + percent) * differ + (100 - percent) * (F.col("around") - F.col("size"))) / twice) - 1
    each = cut(each.withColumns({"differ": differ, "outside": outside, "last": last}))
    several = each.groupBy("lead").agg(F.max("outside").alias("any")).where("any").select("lead")
    tokens = each.join(several, "lead").select("lead", "node", "root", "size", "differ", "outside", "last", F.explode("differs").alias("token"))
    shared = tokens.groupBy("lead", "token").agg(F.count("*").alias("n"), F.count_if("outside").alias("rare")).where("n > 1 AND rare > 0").select("lead", "token", "rare")
    of = Window.partitionBy("lead", "node")
    # What no other set has comes first, wherever it stands.
    place = F.col("differ") - F.count("*").over(of) + F.row_number().over(of.orderBy("rare", "token")) - 1
    placed = cut(tokens.join(shared, ["lead", "token"]).withColumn("place", place).where("outside OR place <= last").drop("rare"))
    x, y = placed.where("outside").alias("x"), placed.where("place <= last").alias("y")
    sizes = F.col("x.size"), F.col("y.size")
    needed = F.ceil(((100 + percent) * (F.col("x.differ") + F.col("y.differ")) - (100 - percent) * (sizes[0] + sizes[1])) / twice)
    apart = (F.col("x.root") != F.col("y.root")) & (100 * F.least(*sizes) >= percent * F.greatest(*sizes))
    met = x.join(y, ["lead", "token"]).where(apart & (F.col("x.place") <= F.col("x.differ") - needed) & (F.col("y.place") <= F.col("y.differ") - needed))
    return met.select(F.least("x.node", "y.node").alias("src"), F.greatest("x.node", "y.node").alias("dst")).distinct()
