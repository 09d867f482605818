"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents.

One pass counts, for every distinct line key of a document, two 64-bit hashes; only keys that reach
the threshold are indexed. Each shard of them becomes a minimal perfect hash (levels of bit vectors
in which a key's bit stands alone) whose slots hold a 64-bit fingerprint and a document count. The
shards are broadcast behind a check of their size and each document probes the arrays. Beyond that
size the documents' line hashes are joined with the counted hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, keyed, portions

SHARD_KEYS, BROADCAST_BYTES = 500_000, 64 << 20


def line_hashes(text: bytes | None, min_chars: int = 1) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text, and for each the two hashes of its key (0, 0 if the key is too short to count)."""
    lines = (text or b"").split(b"\n")
    out = np.zeros((len(lines), 2), np.uint64)
    for i, line in enumerate(lines):
        key = line.strip().lower()  # bytes: ASCII white space and A-Z only
        if len(key) >= min_chars and (min_chars == 1 or len(key.decode("utf-8", "replace")) >= min_chars) and key:
            first = xxhash.xxh64_intdigest(key, 42)
            out[i] = first, xxhash.xxh64_intdigest(key, first)
    return lines, out


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: for each level a bit vector, and the ranks of its words."""

    def __init__(self, keys: np.ndarray, spread: float = 1.5):
        self.levels, base = [], 0
        while len(keys):
            size = 64 * (int(len(keys) * spread) // 64 + 1)
            at = (_mixed(keys, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = base + np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self.levels.append((bits, ranks))
            keys, base = keys[~alone[at]], int(ranks[-1])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't in the hash any slot or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(self.levels):
            at = _mixed(keys[left], level) % np.uint64(64 * len(bits))
            word, bit = bits[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (ranks[(at >> np.uint64(6)).astype(np.int64)] + below)[hit]
            left = left[~hit]
        return out


class LineIndex:
    """One shard: the perfect hash with its fingerprint and count arrays."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        _, first = np.unique(keys, return_index=True)
        rest = np.setdiff1d(np.arange(len(keys)), first)  # equal keys of different lines: looked up one by one
        self.rest = {(int(keys[i]), int(prints[i])): int(counts[i]) for i in rest}
        self.hash = PerfectHash(keys[first])
        slots = self.hash.slots(keys[first])
        self.prints, self.counts = np.empty(len(first), np.uint64), np.empty(len(first), np.int64)
        self.prints[slots], self.counts[slots] = prints[first], counts[first]

    def count(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Document counts; 0 for lines that aren't indexed."""
        slots = self.hash.slots(keys)
        safe = np.maximum(slots, 0)
        out = np.where((slots >= 0) & (self.prints[safe] == prints), self.counts[safe], 0) if len(self.prints) else np.zeros(len(keys), np.int64)
        for i in range(len(keys)) if self.rest else ():
            out[i] = self.rest.get((int(keys[i]), int(prints[i])), out[i])
        return out


def counted_lines(docs: DataFrame, min_docs: int, text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): hashes of the keys found in at least ``min_docs`` rows, with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = np.unique(line_hashes(text.as_py(), min_chars)[1], axis=0)
                found = found[found.any(1)].view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in (0, 1)], ["h1", "h2"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in run(batches):
            held.append(batch)
            if len(held) >= 2000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    hashes = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(together, "h1 long, h2 long")
    return hashes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)


def build_shards(counted: DataFrame, n_keys: int) -> DataFrame:
    """(shard, index): a pickled LineIndex of about SHARD_KEYS keys a row."""
    import pickle

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.ascontiguousarray(rows[c].to_numpy(np.int64)).view(np.uint64) for c in ("h1", "h2")]
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "index": [pickle.dumps(LineIndex(*arrays, rows["n"].to_numpy(np.int64)))]})

    shards = max(1, -(-n_keys // SHARD_KEYS))
    return counted.withColumn("shard", F.pmod("h2", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, index binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row: lines whose key is in ``min_docs`` rows or more are gone.

    A text is split at \\n; a null or empty text is one empty line. A key is its line without the white
    space at both ends, A-Z lower-cased; keys of fewer than ``min_chars`` code points are kept and not
    counted. Rows that repeat an id, or have none, are rows of their own. An empty table gives no rows.
    Columns other than id and text aren't read.
    """
    import pickle

    spark = docs.sparkSession
    counted = cut(counted_lines(docs, min_docs, text_col, min_chars))
    n_keys = counted.count()
    slim = keyed(docs, id_col, text_col)
    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, text string"
    shards = cut(build_shards(counted, n_keys))
    size = shards.agg(F.coalesce(F.sum(F.octet_length("index")), F.lit(0))).first()[0]

    def rows(ids: pa.Array, texts: list, gone: list[np.ndarray], lines: list[list[bytes]]) -> pa.RecordBatch:
        kept = [b"\n".join(x for x, no in zip(ls, g) if not no) if g.any() else (t or b"") for t, ls, g in zip(texts, lines, gone)]
        arrays = [ids, pa.array([len(x) for x in lines], pa.int64()), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "text"])

    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["index"]) for r in shards.toLocalIterator()})
        total = max(1, -(-n_keys // SHARD_KEYS))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = {k: pickle.loads(v) for k, v in held.value.items()}
            for batch in (part for whole in batches for part in portions(whole)):
                texts = batch.column("text").to_pylist()
                split = [line_hashes(x, min_chars) for x in texts]
                hashes = np.concatenate([h for _, h in split]) if split else np.zeros((0, 2), np.uint64)
                shard = hashes[:, 1].view(np.int64) % total if total > 1 else np.zeros(len(hashes), np.int64)
                gone = np.zeros(len(hashes), bool)
                for k, index in indexes.items():
                    mine = np.flatnonzero((shard == k) & hashes.any(1))
                    gone[mine] = index.count(hashes[mine, 0], hashes[mine, 1]) >= min_docs
                yield rows(batch.column("doc_id"), texts, np.split(gone, np.cumsum([len(x) for x, _ in split])[:-1]) if split else [], [x for x, _ in split])

        return slim.mapInArrow(probe, schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                hashes = line_hashes(text.as_py(), min_chars)[1].view(np.int64)
                parts = [pa.array(np.ascontiguousarray(x)) for x in (np.arange(len(hashes)), hashes[:, 0], hashes[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("doc_id")[i], len(hashes)), pa.repeat(batch.column("key")[i], len(hashes)), *parts], ["doc_id", "key", "at", "h1", "h2"])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            texts, hits = batch.column("text").to_pylist(), batch.column("hits").to_pylist()
            lines = [(x or b"").split(b"\n") for x in texts]
            gone = [np.isin(np.arange(len(x)), h or []) for x, h in zip(lines, hits)]
            yield rows(batch.column("doc_id"), texts, gone, lines)

    at = slim.mapInArrow(explode, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, key long, at long, h1 long, h2 long")
    hits = at.join(counted, ["h1", "h2"], "left_semi").groupBy("doc_id", "key").agg(F.collect_set("at").alias("hits"))
    a, b = slim.alias("a"), hits.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return joined.select("a.doc_id", "a.text", "b.hits").mapInArrow(rebuild, schema)
