"""SimHash near-dedup of whole texts: five-word shingles, a Jaccard index of 0.8 or more.

Two bits of 64, as operator 1's query has them, link hardly more than equal shingles; sets with an index of
0.8 differ in 15 % of their bits. So fingerprints are wide here and multi-index hashing looks at segments of
24 bits: each set's fingerprint enters the table under the value of every segment, and probes it with the
values of a Hamming ball around it. A ball holds the ``PROBES`` likeliest ways to differ in the segment: bits
whose votes are about even flip first, so few probes do what a ball over all bits would need thousands for.
Pairs met in the table are verified by the distance of whole fingerprints and last on the whole sets.

Texts that are equal are one node. Members of a bucket are compared with its lead, each with the nearest
leads first; of buckets whose members are still in several components those around one lead are compared by
their differences from it (``differences``), and only what is far from it across components. Whole fingerprints
keep the triangle inequality, so this loses no link between components, and never makes all pairs of a group
of copies.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.llm import differences
from sagaframe.llm.common import checkpoint_dir, cut, portions
from sagaframe.llm.graph import connected_components

SHINGLE, SEGMENTS, WIDTH, UNSURE, PROBES, PRINTS, BROADCAST_NODES = 5, 20, 24, 8, 10, 2, 1_000_000
#: Bits that may differ, of the 64 * PRINTS that probes carry and of all 640: at an index of 0.8 they are 19 and 96 on average, 2.7 deviations less.
PRINT_BITS, WHOLE_BITS = 30, 120
#: Nodes whose whole fingerprints differ in no more bits from a lead's are compared by their differences from it alone.
AROUND = 160
_GOLDEN, _A, _B = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: The ways to flip some of a segment's UNSURE least certain bits.
_WAYS = np.array([x for x in range(1 << UNSURE) if x.bit_count() <= 4], np.int64)
_FLIPS = (_WAYS[:, None] >> np.arange(UNSURE) & 1).astype(np.float32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles, sorted; a shorter text is one shingle, a blank one has none."""
    found = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        x = _mixed(x * np.uint64(_GOLDEN) + words[i : len(words) - size + 1 + i])
    return np.unique(x)


def votes(hashes: np.ndarray) -> np.ndarray:
    """How far over half of the shingles set each bit of a fingerprint; none over for no shingles."""
    out = np.zeros(SEGMENTS * WIDTH + 32 + 64 * PRINTS, np.int32)
    for at in range(0, len(hashes), 255):
        part = hashes[at : at + 255]
        bits = np.hstack([_mixed(part ^ np.uint64((k + 1) * _GOLDEN % 2**64))[:, None] for k in range(len(out) // 64)])
        out += np.unpackbits(bits.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return 2 * out - len(hashes)


def balls(made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probes, exact) of fingerprints' segments, of shape (rows, SEGMENTS, PROBES); the exact probe is the segment's own value."""
    margins = made[:, : SEGMENTS * WIDTH].reshape(-1, SEGMENTS, WIDTH)
    places = 1 << np.arange(WIDTH)
    unsure = np.argpartition(np.abs(margins), UNSURE, axis=2)[:, :, :UNSURE]
    costs = np.square(np.take_along_axis(margins, unsure, 2).astype(np.float32)) @ _FLIPS.T
    costs[:, :, 0] = -1  # no flip, whatever the votes
    ways = np.argpartition(costs, PROBES, axis=2)[:, :, :PROBES]
    flips = np.take_along_axis(places[unsure].astype(np.float32) @ _FLIPS.T, ways, 2).astype(np.int64)
    return ((margins > 0) @ places)[:, :, None] ^ flips, ways == 0


def node_of(text: Column) -> Column:
    """Names a text by its hash; all texts without a word are one."""
    return F.xxhash64(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""))


def _once(docs: DataFrame, schema: str, rows) -> DataFrame:
    """``rows(nodes, votes, shingles)`` of the documents (node, text), as lists of columns; a task takes a node once."""
    names = [x.split()[0] for x in schema.split(", ")]

    def made(new: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(rows(np.array(list(new), np.int64), np.stack([votes(x) for x in new.values()]), list(new.values())), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in portions(whole, limit=1 << 20)):
            new: dict[int, np.ndarray] = {}
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                if node not in seen:
                    seen.add(node)
                    new[node] = shingles(text.as_py())
                if len(new) == 256:
                    yield made(new)
                    new = {}
            if len(seen) > BROADCAST_NODES:
                seen.clear()
            if new:
                yield made(new)

    return docs.select("node", F.col("text").cast("binary")).mapInArrow(run, schema)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits > 0, axis=1).view(np.int64)


def entries(docs: DataFrame) -> DataFrame:
    """(key, node, p0, p1, exact): the table's entries and the probes of each document; key names a segment and its value."""

    def rows(nodes: np.ndarray, made: np.ndarray, _) -> list[pa.Array]:
        probes, exact = balls(made)
        keys, each = probes + (np.arange(SEGMENTS) << WIDTH)[None, :, None], SEGMENTS * PROBES
        return [pa.array(keys.ravel()), pa.array(nodes.repeat(each)), *(pa.array(x.repeat(each)) for x in _packed(made[:, -64 * PRINTS :]).T), pa.array(exact.ravel())]

    return _once(docs, "key long, node long, p0 long, p1 long, exact boolean", rows)


def _apart(a: str, b: str) -> Column:
    return functools.reduce(Column.__add__, (F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(PRINTS)))


def _made(docs: DataFrame, nodes: DataFrame, sets: bool) -> DataFrame:
    """(node, whole) of the given nodes, and their ``shingles`` if ``sets``; written as a table."""
    spark, path = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession)}/nodes-{uuid.uuid4().hex}"
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    listed = lambda x: pa.array(list(x), pa.list_(pa.int64()))
    rows = lambda found, made, own: [pa.array(found), listed(_packed(made)), *([listed(x.view(np.int64) for x in own)] if sets else [])]
    columns = ["whole", "shingles"] if sets else ["whole"]
    each = _once(docs.join(wanted, "node", "left_semi"), ", ".join(["node long", *(f"{c} array<long>" for c in columns)]), rows)
    each.groupBy("node").agg(*(F.first(c).alias(c) for c in columns)).write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def _sided(made: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    return tuple(made.select(F.col("node").alias(end), F.col(column).alias(f"_{end}")) for end in ("src", "dst"))


def _bits(a: str, b: str) -> Column:
    """How many bits of whole fingerprints differ."""
    words = (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range((SEGMENTS * WIDTH + 32) // 64 + PRINTS))
    return functools.reduce(Column.__add__, words)


def _close(a: str, b: str) -> Column:
    """Whether whole fingerprints are near enough for similar sets."""
    return _bits(a, b) <= WHOLE_BITS


def _likely(pairs: DataFrame, made: DataFrame) -> DataFrame:
    """The pairs whose whole fingerprints are near enough."""
    a, b = _sided(made, "whole")
    return pairs.select("src", "dst").join(a, "src").join(b, "dst").where(_close("_src", "_dst")).select("src", "dst")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard index of 0.8 or more; two empty sets are equal."""
    a, b = _sided(sets, "shingles")
    same, both = F.size(F.array_intersect("_src", "_dst")), F.size("_src") + F.size("_dst")
    return cut(pairs.select("src", "dst").join(a, "src").join(b, "dst").where(9 * same >= 4 * both).select("src", "dst"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one component."""
    for end in ("src", "dst"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    return pairs.where("_src <> _dst").drop("_src", "_dst")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()


def _several(rooted: DataFrame) -> DataFrame:
    """The buckets (key, node, root) without those that are within one component."""
    several = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("key")
    return cut(rooted.join(several, "key"))


def _led(rooted: DataFrame) -> DataFrame:
    """Buckets (key, node, exact, root, whole) of several components with a ``lead`` each, and by how many bits of whole fingerprints each node differs from it: ``far``.

    A bucket's lead is of the component that is in it most: the node of that component that is in most buckets, this one or others.
    """
    rooted = _several(rooted)
    most = rooted.groupBy("key").agg(F.mode("root", deterministic=True).alias("lead_root"))
    heads = rooted.groupBy("root", "node").agg(F.count("*").alias("n"), F.first("whole").alias("head")).groupBy(F.col("root").alias("lead_root")).agg(F.max_by(F.struct("node", "head"), F.struct("n", "node")).alias("of"))
    leads = most.join(heads, "lead_root").select("key", "lead_root", F.col("of.node").alias("lead"), F.col("of.head").alias("head"))
    return cut(rooted.join(leads, "key").withColumn("far", _bits("whole", "head")).drop("head"))


def links(docs: DataFrame) -> DataFrame:
    """Edges (src, dst) among the nodes of documents (node, text) with the components of all similar pairs that the table holds."""
    every = entries(docs).repartition("key")
    own = F.when(F.col("exact"), F.col("node"))
    prints = [f"p{i}" for i in range(PRINTS)]
    met = every.groupBy("key").agg(F.min(F.when(F.col("exact"), F.struct("node", *prints))).alias("lead"), F.max(own).alias("last"), F.min("node").alias("low"), F.max("node").alias("high"))
    met = met.where("lead IS NOT NULL AND low <> high").select("key", F.col("lead.node").alias("lead"), *(F.col(f"lead.{p}").alias(f"l{i}") for i, p in enumerate(prints)), (F.col("last") != F.col("lead.node")).alias("many"))
    met = every.join(met, "key").where((F.col("node") == F.col("lead")) | F.col("many") | (_apart("p", "l") <= PRINT_BITS))
    met = cut(met.groupBy("key", "node").agg(F.max("exact").alias("exact"), *(F.first(x).alias(x) for x in (*prints, "lead", "l0", "l1", "many"))))
    near_lead = (F.col("node") != F.col("lead")) & (_apart("p", "l") <= PRINT_BITS)
    stars = cut(met.where(near_lead).groupBy(F.col("lead").alias("src"), F.col("node").alias("dst")).agg(F.min(_apart("p", "l")).alias("apart")))
    sets = _made(docs, _ends(stars), sets=True)
    ranked = cut(stars.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("apart", "src"))))
    near = _verified(ranked.where("place <= 2"), sets)
    left = cut(_across(ranked.where("place > 2").select("src", "dst"), connected_components(near)))
    near = near.union(_verified(_likely(left, sets), sets))
    roots = connected_components(near)
    several = met.where("many").select("key", "node", "exact")
    rooted = several.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut(rooted.join(_made(docs, several.select("node").distinct(), sets=False), "node"))
    led = _led(rooted)
    groups = cut(led.where(F.col("far") <= AROUND + WHOLE_BITS).select("lead", "node", "root").distinct())
    mixed = groups.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("lead")
    groups = cut(groups.join(mixed, "lead"))
    around = _made(docs, _ends(groups.select(F.col("lead").alias("src"), F.col("node").alias("dst"))), sets=True)
    stars_ = led.where((F.col("far") <= WHOLE_BITS) & (F.col("root") != F.col("lead_root"))).select(F.least("node", "lead").alias("src"), F.greatest("node", "lead").alias("dst"))
    rest = _several(led.where(F.col("far") > AROUND).select("key", "node", "exact", "root", "whole"))
    x, y = rest.alias("x"), rest.alias("y")
    across = (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, "key").where(across & (F.col("x.exact") | F.col("y.exact")) & _close("x.whole", "y.whole"))
    pairs = pairs.select(F.col("x.node").alias("src"), F.col("y.node").alias("dst")).union(stars_).union(differences.similar(groups, around, 80)).distinct()
    tried = stars.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    pairs = cut(pairs.join(tried, ["src", "dst"], "left_anti"))
    return near.union(_verified(pairs, _made(docs, _ends(pairs), sets=True)))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, least, root) of the nodes of documents (doc_id, text, node), and (root, component_id)."""
    nodes = docs.groupBy("node").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(docs.select("node", "text"))).withColumnRenamed("root", "_root")
    rooted = cut(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("_root", "node").alias("root")))
    return rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of a Jaccard index of 0.8 or more; it is null
    where no text of a component has an id. Null, empty and blank texts link with one another. Rows that
    repeat an id are rows of their own. An empty table gives no rows. Other columns aren't read.
    """
    named = _named(docs, id_col, text_col)
    rooted, least = _rooted(named)
    return named.select("doc_id", "node").join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, with the same columns: a row with the smallest id, or with none where no row has one.

    Of rows that repeat that id or have none in a component one stays, whatever else they hold. Whole texts
    move only where nodes that lose rows are too many to broadcast.
    """
    named = _named(docs, id_col, text_col)
    rooted, _ = _rooted(named)
    best = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("best")
    kept = rooted.groupBy("root").agg(best).select("root", F.col("best.node").alias("kept"), F.col("best.least").alias("id"))
    counts = named.groupBy("node").agg(F.count("*").alias("n"))
    # Nodes of which rows go: all of them, or all but one that has the id.
    told = rooted.join(kept, "root").join(counts, "node").withColumn("stays", F.col("node") == F.col("kept"))
    told = cut(told.where(~F.col("stays") | (F.col("n") > 1)).select("node", "stays", "id"))
    few = F.broadcast if told.count() <= BROADCAST_NODES else lambda x: x
    tagged = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), node_of(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("node"))
    whole = tagged.join(few(told.select("node")), "node", "left_anti")
    one = tagged.join(few(told.where("stays")), "node").where(F.col("_id").eqNullSafe(F.col("id"))).dropDuplicates(["node"])
    return whole.select("_row").union(one.select("_row")).select("_row.*")
