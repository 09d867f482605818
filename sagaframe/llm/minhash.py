"""MinHash near-dedup by an inverted join on signature coordinates.

Each set of shingles has a signature of COORDINATES minima. A document is posted under every pair of a coordinate
and its value; documents with similar sets collide in many of them: at a Jaccard index of 0.8 fewer than MATCHES
of them collide with a probability of 2e-7. So pairs with MATCHES collisions are retained, unless their sizes or
the sketches of many more coordinates, of which one bit each is kept, rule them out, and confirmed on their whole
sets.

Lists are merged with two savings that lose none of these pairs. *Prefix*: of two signatures with MATCHES equal
coordinates, one is among any COORDINATES - MATCHES + 1 coordinates of either, so a document is posted under
its rarest ones only. *Skip*: a value that no other document has collides with nothing; it takes its place in the
prefix without being posted, and a document that has fewer than MATCHES other values is skipped altogether.

Documents with equal sets are one node. A list of many nodes isn't expanded into pairs: its nodes are compared with a
central one of them, its lead. Where several components are left, the nodes around the lead are compared by their
differences from it (``differences``). Sketches that differ in APART bits at most keep the triangle inequality: of a pair
with one node within AROUND bits of the lead, the other is within AROUND + APART. So only nodes beyond AROUND are left
for comparison across components, by sizes and sketches first. So the components are those of all retained pairs.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm import differences
from sagaframe.llm.common import checkpoint_dir, cut, portions
from sagaframe.llm.graph import connected_components
from sagaframe.llm.nearcopies import shingles

COORDINATES, MATCHES, CHUNK, BROADCAST_NODES = 32, 13, 4096, 1_000_000
#: Nodes of a list that are compared with one another without a lead.
SHORT = 16
#: Bits of a sketch, and how many may differ: over so many do with a probability of 2e-7 at an index of 0.8.
BITS, APART = 512, 88
#: Nodes whose sketches differ in no more bits from a lead's are compared by their differences from it alone.
AROUND = 64
#: One odd factor and one summand for each coordinate and each bit.
_DRAWN = np.random.default_rng(13).integers(0, 1 << 63, (2, COORDINATES + BITS, 1), np.uint64)
_FACTORS, _SUMMANDS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def _least(hashes: np.ndarray, which: slice) -> np.ndarray:
    factors, summands = _FACTORS[which], _SUMMANDS[which]
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, (factors * hashes[at : at + CHUNK] + summands).min(1), out=least)
    return least


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes at each coordinate, with the coordinate in its low bits, so that no value is another coordinate's."""
    least = _least(hashes, slice(COORDINATES))
    return (least // np.uint64(COORDINATES) * np.uint64(COORDINATES) + np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of the least hash at BITS further coordinates: sets differ in half as many of them as they have not in common."""
    return np.packbits((_least(hashes, slice(COORDINATES, None)) >> np.uint64(24) & np.uint64(1)).astype(bool)).view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    """Names a set of sorted hashes."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, key, node, n_shingles, signature, sketch) of documents (doc_id, key, text): key names the text, node its set; the last two are null where the set is empty or the task had it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[int, int]] = {}
        nodes: set[int] = set()
        for batch in (part for whole in batches for part in portions(whole)):
            named, made, drawn = [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                made.append(None)
                drawn.append(None)
                if key not in texts:
                    own = shingles(text.as_py(), shingle)
                    node = node_of(own)
                    texts[key] = node, len(own)
                    if len(own) and node not in nodes:
                        nodes.add(node)
                        made[-1], drawn[-1] = signature(own), sketch(own)
                named.append(texts[key])
            if len(texts) > BROADCAST_NODES:
                texts.clear()
                nodes.clear()
            node, size = zip(*named)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(made, pa.list_(pa.int64())), pa.array(drawn, pa.list_(pa.int64()))], ["doc_id", "key", "node", "n_shingles", "signature", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "key", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, key long, node long, n_shingles long, signature array<long>, sketch array<long>")


def sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the ``wanted`` (key, node), from documents (key, text); written as a table."""
    spark, path = docs.sparkSession, f"{checkpoint_dir(docs.sparkSession)}/sets-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in portions(whole, limit=1 << 20)):
            new = {n: shingles(t.as_py(), shingle) for n, t in zip(batch.column("node").to_pylist(), batch.column("text")) if n not in seen}
            seen.update(new)
            if len(seen) > BROADCAST_NODES:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array([x.view(np.int64) for x in new.values()], pa.list_(pa.int64()))], ["node", "shingles"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
    each = docs.join(few, "key").select("node", F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<long>")
    each.groupBy("node").agg(F.first("shingles").alias("shingles")).write.option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def posts(nodes: DataFrame) -> DataFrame:
    """(token, node, central): the lists that are merged, each node under the rarest of its shared values.

    ``central`` is how often a node's values are shared in all: what other texts are copies of comes before those copies.
    """
    tokens = nodes.select("node", F.explode("signature").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    each = tokens.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"))
    prefix = F.slice("shared", 1, F.size("shared") - (MATCHES - 1))
    central = F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + x["n"])
    kept = each.where(F.size("shared") >= MATCHES).select("node", F.transform(prefix, lambda x: x["token"]).alias("prefix"), central.alias("central"))
    return kept.select(F.explode("prefix").alias("token"), "node", "central")


def collisions(a: str, b: str) -> Column:
    """How many coordinates of two signatures are equal; a value tells its coordinate."""
    return F.size(F.array_intersect(a, b))


def apart(a: str, b: str) -> Column:
    """How many bits of two sketches differ."""
    return functools.reduce(Column.__add__, (F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(BITS // 64)))


def _sided(pairs: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Pairs (src, dst) with columns of their nodes as ``a_`` and ``b_``."""
    for end, mark in (("dst", "b"), ("src", "a")):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{mark}_{c}") for c in columns)), end)
    return pairs


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches allow ``percent`` in common; a pair that has it fails with a probability of 2e-7."""
    sizes = F.col(f"{a}size"), F.col(f"{b}size")
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (apart(f"{a}sketch", f"{b}sketch") <= APART)


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (src, dst) with MATCHES collisions or more whose sets have ``percent`` or more of their union in common."""
    retained = cut(_sided(pairs, nodes, "signature").where(collisions("a_signature", "b_signature") >= MATCHES).select("src", "dst"))
    ends = retained.select(F.col("src").alias("node")).union(retained.select("dst")).distinct()
    whole = sets(docs, nodes.join(ends, "node", "left_semi").select("key", "node"), shingle)
    same, both = F.size(F.array_intersect("a_shingles", "b_shingles")), F.size("a_shingles") + F.size("b_shingles")
    return cut(_sided(retained, whole, "shingles").where(100 * same >= percent * (both - same)).select("src", "dst"))


def _several(lists: DataFrame) -> DataFrame:
    """The lists without those that are within one component."""
    several = lists.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low <> _high").select("token")
    return lists.join(several, "token")


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]


def _among(lists: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of each list's nodes that aren't in one component and that sizes and sketches allow."""
    x, y = (lists.join(nodes.select("node", "size", "sketch"), "node").select("token", *(F.col(c).alias(f"{mark}_{c}") for c in ("node", "root", "size", "sketch"))) for mark in "ab")
    return x.join(y, "token").where("a_node < b_node AND a_root <> b_root").where(alike("a_", "b_", percent)).select(F.col("a_node").alias("src"), F.col("b_node").alias("dst"))


def _led(lists: DataFrame, leads: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lists (token, node, central, root) with their ``leads`` (token, lead, lead_root), and by how many bits of sketches each node differs from its own: ``far``."""
    led = lists.join(leads, "token")
    stars = _sided(led.select(F.col("node").alias("src"), F.col("lead").alias("dst")).distinct(), nodes, "sketch")
    stars = stars.select(F.col("src").alias("node"), F.col("dst").alias("lead"), apart("a_sketch", "b_sketch").alias("far"))
    return cut(led.join(stars, ["node", "lead"]))


def _gathered(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """``_led`` with few leads for many lists, in the list or not: the most central node of the component that a list has most of, or one around it that leads more."""
    heads = lists.groupBy(F.col("root").alias("lead_root")).agg(F.max_by("node", F.struct("central", "node")).alias("lead"))
    leads = cut(lists.groupBy("token").agg(F.mode("root", deterministic=True).alias("lead_root")).join(heads, "lead_root"))
    led = _led(lists, leads, nodes)
    weights = led.groupBy("lead").agg(F.count("*").alias("n"))
    around = led.where((F.col("far") <= AROUND) & (F.col("node") != F.col("lead"))).join(weights, "lead").join(weights.select(F.col("lead").alias("node"), F.col("n").alias("own")), "node")
    most = F.struct("n", "lead")
    better = around.where(most > F.struct(F.col("own"), F.col("node"))).groupBy(F.col("node").alias("lead")).agg(F.max_by("lead", most).alias("better"), F.max_by("lead_root", most).alias("better_root"))
    better = cut(leads.join(better, "lead").select("token", F.col("better").alias("lead"), F.col("better_root").alias("lead_root")))
    same = led.join(better.select("token"), "token", "left_anti")
    return cut(same.unionByName(_led(lists, better, nodes)))


def _stars(led: DataFrame) -> DataFrame:
    """The pairs of nodes with leads of other components that sketches allow."""
    return led.where(F.col("far") <= APART).where("root <> lead_root").select(*_ends("node", "lead")).distinct()


def _sizes_allow(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    return _sided(pairs, nodes, "size").where(100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")).select("src", "dst")


def links(nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (src, dst) among nodes (node, key, size, signature, sketch) with the components of all retained and confirmed pairs."""
    lists = cut(posts(nodes.select("node", "signature")).withColumn("root", F.col("node")))
    long = lists.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select("token")
    short, long = lists.join(long, "token", "left_anti"), lists.join(long, "token")
    most = F.struct("central", "node")
    leads = long.groupBy("token").agg(F.max_by("node", most).alias("lead"), F.max_by("root", most).alias("lead_root"))
    stars = _sizes_allow(_stars(_led(long, leads, nodes)), nodes, percent)
    found = confirmed(cut(_among(short, nodes, percent).union(stars).distinct()), nodes, docs, shingle, percent)
    rest = long.drop("root").join(connected_components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    led = _gathered(cut(_several(rest)), nodes)
    rest = cut(_several(led.where(F.col("far") > AROUND).select("token", "node", "root")))
    groups = cut(led.where(F.col("far") <= AROUND + APART).select("lead", "node", "root").distinct())
    several = groups.groupBy("lead").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count_if(F.col("node") != F.col("lead")).alias("n")).where("_low <> _high AND n > 1").select("lead")
    groups = cut(groups.join(several, "lead"))
    wanted = groups.select("node").union(groups.select("lead")).distinct()
    whole = sets(docs, nodes.join(wanted, "node", "left_semi").select("key", "node"), shingle)
    pairs = _sizes_allow(_stars(led), nodes, percent).union(_among(rest, nodes, percent)).union(differences.similar(groups, whole, percent)).distinct()
    return found.union(confirmed(cut(pairs), nodes, docs, shingle, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    component_id is the smallest id reachable over links of ``percent`` or more in common; kept tells whether it
    is the row's own. Null, empty and blank texts have no shingles and no links: component_id is their own id.
    Rows that repeat an id are rows of their own, and all kept if one is. A null id is never chosen and never
    kept, so that component_id is null where a component has null ids only. A text of any length is one row,
    taken by itself. An empty table gives no rows. Other columns aren't read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    each = cut(signatures(slim, shingle))
    nodes = cut(each.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("n_shingles").alias("size"), F.first("signature", ignorenulls=True).alias("signature"), F.first("sketch", ignorenulls=True).alias("sketch")))
    roots = connected_components(links(nodes, slim, shingle, percent)).withColumnRenamed("root", "_root")
    rooted = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("_root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("node", "component_id")
    told = each.select("doc_id", "node", "n_shingles").join(classes, "node", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return told.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
