"""SimHash near-dedup by multi-index hashing.

Fingerprints of 64 bits link when at most two bits differ. Each is cut into two segments of 32 bits:
of two bits at most one falls into one of the segments, so a probe with every value within one bit
of a segment (its Hamming ball) meets each linked fingerprint in the table, where the whole distance
is verified. Of two segments that differ in one bit only the one with a 0 there probes the other,
so half a ball finds each pair.

A table bucket with more than ``bucket_cap`` fingerprints would be compared member by member. Its
members and probes are linked instead by their common neighbours: two fingerprints are within two
bits if and only if some value lies within one bit of both. Such a value has 65 fingerprints around
it at most, all within two bits of each other, so that linking each to the least of them is exact
for the components and linear in the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, portions
from sagaframe.llm.graph import connected_components

MAX_DISTANCE, SEED, CHUNK = 2, 42, 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: a bit is set where over half of the shingles' XXH64 have it."""
    found = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return 0
    joined = map(b" ".join, zip(*(found[i:] for i in range(shingle)))) if len(found) >= shingle else [b" ".join(found)]
    total = max(1, len(found) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in joined), np.uint64, total).astype(">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long, zero for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            made = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _segments(fps: DataFrame) -> DataFrame:
    low, high = F.col("fp").bitwiseAND((1 << 32) - 1), F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.inline(F.array(*(F.struct(F.lit(i).cast("byte").alias("segment"), x.alias("value")) for i, x in enumerate((low, high))))))


def links(fps: DataFrame, bucket_cap: int = 100) -> DataFrame:
    """Edges (src, dst) among distinct fingerprints ``fp`` with the components of all pairs within two bits."""
    table = _segments(fps)
    flips = F.array(*(F.lit(1 << i) for i in range(32)))
    near = F.transform(F.filter(flips, lambda x: F.col("value").bitwiseAND(x) == 0), lambda x: F.col("value").bitwiseXOR(x))
    probes = table.select(F.col("fp").alias("src"), "segment", F.explode(F.concat(F.array("value"), near)).alias("value"))
    hot = cut(table.groupBy("segment", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket_cap).drop("n"))
    any_hot = not hot.isEmpty()
    cold = table.join(hot, ["segment", "value"], "left_anti") if any_hot else table
    apart = F.bit_count(F.col("src").bitwiseXOR(F.col("fp")))
    edges = probes.join(cold, ["segment", "value"]).where(apart.between(1, MAX_DISTANCE)).select("src", F.col("fp").alias("dst"))
    if any_hot:
        around = F.array(*(F.lit(x) for x in [0, *(_signed(1 << i) for i in range(64))]))
        met = probes.join(hot, ["segment", "value"], "left_semi").select(F.col("src").alias("fp")).distinct()
        common = met.select("fp", F.explode(F.transform(around, lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
        stars = common.groupBy("middle").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
        edges = edges.union(stars.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).where("src <> dst"))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket_cap: int = 100) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of at most two bits. Null, empty and blank
    texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their own;
    a null id is carried but never chosen, so a component with null ids only has component_id null.
    An empty table gives no rows. Other columns of ``docs``, whatever their names, aren't read.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp"), bucket_cap)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return each.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

