"""Substring dedup with suffix automata over reference passages.

A passage of ``length`` words or more that two documents share has one anchor in both, whatever
stands around it: of the k-grams of any window of ``length`` words the one with the least hash
(winnowing). Anchors met in two documents or more are kept; around each, a document's reference
passage holds all its windows that have this anchor. The distinct passages of an anchor are streamed
through a suffix automaton in order of their documents: by matching statistics each learns for all its
windows in which document they are met first, and what it has first is added. Words of windows that a
smaller id has are removed.

Automata over all documents would grow with the corpus and could not be broadcast, so they are built
shard by shard in the tasks that the passages of their anchors are sent to. Which anchors are wanted is
broadcast as a filter of bits that the tasks make block by block, so the driver holds at most
``FILTER_BITS`` of them and no list of anchors; beyond a number of anchors they are joined. The filter
leaves none out but lets some others through: an anchor of one document has its windows first itself,
and one with a single passage gets an automaton it doesn't need.

Passages are told apart by two hashes, and their texts go only where an automaton needs them. An
anchor with one distinct passage needs none: all its windows are met first where the passage is. An
anchor with more than ``passage_cap`` of them, or met more than ``row_cap`` times, gets none either: its
windows are grouped by their hashes, which is as exact and needs no group in one task. So the rows of
a shard are bounded, whatever is copied how often. Tasks keep one copy of each passage before they send any.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagaframe.llm.common import checkpoint_dir, cut, keyed, portions

GRAM, BROADCAST_ANCHORS, SHARD_ROWS, HELD_BYTES, SALTS = 12, 40_000_000, 8000, 32 << 20, 8
#: Six bits or more for each of BROADCAST_ANCHORS, 16 for fewer; how many hot anchors are broadcast themselves.
FILTER_BITS, BROADCAST_HOT = 1 << 28, 250_000
CHUNK, _PLACES = 1 << 16, (1 << 20) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def anchors(texts: list[bytes | None], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the k-grams that are the least of some window of ``length`` words of a text."""
    gram, split = min(GRAM, length), [(x or b"").split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    n = int(counts.sum())
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain.from_iterable(split)), np.uint64, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _powers(_BASE, n), dtype=np.uint64)])
    x = (sums[gram:] - sums[:-gram]) * _powers(_INVERSE, n - gram + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    text, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    width, places = length - gram + 1, []
    for at in range(0, len(x) - width + 1, CHUNK):
        # The high bits of a hash with its place tell the leftmost least; minima over 1, 2, 4, ... places make those over ``width``.
        part = x[at : at + CHUNK + width - 1]
        least = part & ~np.uint64(_PLACES) | np.arange(len(part), dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        if reach < width:
            least = np.minimum(least[: reach - width], least[width - reach :])
        own = slice(at, at + len(least))
        inside = np.arange(at, at + len(least)) + length <= (first + counts)[text[own]]  # the window ends in its text
        places.append(np.unique((least[inside] & np.uint64(_PLACES)).astype(np.int64)) + at)
    found = np.unique(np.concatenate(places))
    return text[found], found - first[text[found]], x[found].view(np.int64)


class SuffixAutomaton:
    """A generalised suffix automaton over sequences of words, named by numbers, added in rising order of their documents.

    ``first`` of a state is the least document of its occurrences: the one that was added when it came to be, which a clone inherits.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [0]

    def _state(self, size: int, following: dict, link: int, first: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.first.append(first)
        return len(self.size) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q], self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[int], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, q, word)
            else:
                now, p = self._state(self.size[last] + 1, {}, 0, doc), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = now
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[now] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, word)
                last = now

    def firsts(self, words: list[int], length: int) -> list[int | None]:
        """For each window of ``length`` words the least document that has it, by matching statistics."""
        out, v, matched = [], 0, 0
        for at, word in enumerate(words, 1):
            while v and word not in self.next[v]:
                v = self.link[v]
                matched = self.size[v]
            if word in self.next[v]:
                v, matched = self.next[v][word], matched + 1
            if at >= length:
                u = v
                while matched >= length and self.size[self.link[u]] >= length:
                    u = self.link[u]
                out.append(self.first[u] if matched >= length else None)
        return out

    def meet(self, words: list[int], length: int, doc: int) -> list[int]:
        """``firsts`` of a document no less than those before; what it has first is added."""
        out, at = self.firsts(words, length), 0
        while at < len(out):
            start = at
            while at < len(out) and out[at] is None:
                out[at], at = doc, at + 1
            if at > start:
                self.add(words[start : at - 1 + length], doc)
            at += 1
        return out


def matched_passages(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """One shard: (h, s1, s2, passage, least) to (h, s1, s2, firsts), an automaton for each anchor. Rows may repeat a passage with another ``least``."""
    rows, out, held = rows.sort_values("least", kind="stable").drop_duplicates(["h", "s1", "s2"]), [], None
    rows, named = rows.sort_values("h", kind="stable"), {}
    for h, least, text in zip(rows["h"].to_numpy(), rows["least"].to_numpy(), rows["passage"]):
        if h != held:
            held, automaton = h, SuffixAutomaton()
        out.append(automaton.meet([named.setdefault(w, len(named)) for w in bytes(text).split()], length, int(least)))
    return rows[["h", "s1", "s2"]].assign(firsts=out)


def _places(h: np.ndarray, blocks: int) -> list[np.ndarray]:
    """The three bits of each anchor, all in one block of 65,536."""
    h = h.view(np.uint64)
    block = (h >> np.uint64(48) & np.uint64(blocks - 1)) << np.uint64(16)
    return [(block | h >> np.uint64(by) & np.uint64(0xFFFF)).view(np.int64) for by in (0, 16, 32)]


def anchor_filter(anchors: DataFrame, n: int) -> np.ndarray:
    """The bits of the ``n`` anchors ``h`` of a table, eight a byte. Each task makes those of its blocks; no anchor goes to the driver."""
    blocks = min(FILTER_BITS, max(1 << 22, 1 << (16 * n - 1).bit_length())) >> 16

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((blocks, 1 << 13), np.uint8)
        for batch in batches:
            for place in _places(batch.column("h").to_numpy(), blocks):
                np.bitwise_or.at(bits.reshape(-1), place >> 3, (1 << (place & 7)).astype(np.uint8))
        for block in np.flatnonzero(bits.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits[block].tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros((blocks, 1 << 13), np.uint8)
    dealt = anchors.select("h").repartition(F.shiftrightunsigned("h", 48).bitwiseAND(blocks - 1))
    for batch in dealt.mapInArrow(made, "block int, bits binary").toArrow().to_batches():
        for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits")):
            out[block] |= np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


def _let_through(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` a filter lets through: all of its anchors, and a few others."""
    out = np.ones(len(h), bool)
    for place in _places(h, len(bits) >> 13):
        out &= (bits[place >> 3] >> (place & 7) & 1).astype(bool)
    return out


def _passages(batch: pa.RecordBatch, places: list, length: int) -> pa.RecordBatch | None:
    """The passage around each of a row's anchors: (position, hash) pairs in ``places``."""
    reach, rows = length - min(GRAM, length), []
    for n, (text, found) in enumerate(zip(batch.column("text").to_pylist(), places)):
        words = text.split() if found else []
        for at, h in found:
            start, end = max(0, at - reach), min(len(words), at + length)
            passage = b" ".join(words[start:end])
            rows.append((n, start, end - start - length + 1, h, xxhash.xxh64_intdigest(passage, 1) - 2**63, xxhash.xxh64_intdigest(passage, 2) - 2**63, passage))
    if not rows:
        return None
    index, *columns = zip(*rows)
    taken = [batch.column(c).take(pa.array(index, pa.int64())) for c in ("doc_id", "key")]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "key", "start", "windows", "h", "s1", "s2", "passage"])


_PASSAGES = "doc_id long, key long, start long, windows int, h long, s1 long, s2 long, passage binary"


def reference_passages(slim: DataFrame, length: int, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(doc_id, key, start, windows, h, s1, s2, passage) for each anchor that two documents or more have, and for some of the others; ``windows`` is how many the passage holds."""

    def listed(batches: Iterator[pa.RecordBatch], ids: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            text, at, h = anchors(batch.column("text").to_pylist(), length)
            columns = {"doc_id": batch.column("doc_id").take(pa.array(text)), "key": batch.column("key").take(pa.array(text)), "at": pa.array(at), "h": pa.array(h)}
            yield pa.RecordBatch.from_arrays([columns[c] for c in ids], list(ids))

    ends = slim.mapInArrow(lambda b: listed(b, ("doc_id", "h")), "doc_id long, h long").groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    repeated = cut(ends.where("a < b").select("h"))
    n = repeated.count()
    if n <= broadcast_anchors:
        held = slim.sparkSession.sparkContext.broadcast(anchor_filter(repeated, n))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = held.value
            for batch in (part for whole in batches for part in portions(whole)):
                places: list[list] = [[] for _ in range(len(batch))]
                text, at, h = anchors(batch.column("text").to_pylist(), length)
                hit = _let_through(known, h)
                for i, *place in zip(*(x[hit].tolist() for x in (text, at, h))):
                    places[i].append(place)
                if (made := _passages(batch, places, length)) is not None:
                    yield made

        return slim.mapInArrow(near, _PASSAGES)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            if (made := _passages(batch, [[(x["at"], x["h"]) for x in found] for found in batch.column("hits").to_pylist()], length)) is not None:
                yield made

    every = slim.mapInArrow(lambda b: listed(b, ("doc_id", "key", "at", "h")), "doc_id long, key long, at long, h long")
    hits = every.join(repeated, "h", "left_semi").groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "h")).alias("hits"))
    return slim.join(hits, ["doc_id", "key"]).mapInArrow(around, _PASSAGES)


def _texts(passages: DataFrame, anchors: DataFrame, n_anchors: int, broadcast_anchors: int, hot: DataFrame | None = None, n_hot: int = 0) -> DataFrame:
    """(h, s1, s2, least, passage) of the given anchors' passages, one copy of each for a task as long as it can hold them. A filter may let others through, but none of ``hot``."""
    few = n_anchors <= broadcast_anchors and n_hot <= BROADCAST_HOT
    held = passages.sparkSession.sparkContext.broadcast((anchor_filter(anchors, n_anchors), hot.select("h").toArrow().column("h").to_numpy() if n_hot else np.zeros(0, np.int64))) if few else None
    columns = ["h", "s1", "s2", "least", "passage"]

    def made(seen: dict) -> pa.RecordBatch:
        types = [*[pa.int64()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*zip(*seen), *zip(*seen.values())], types)], columns)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = {}, 0
        for batch in batches:
            if held is not None:
                bits, others = held.value
                h = batch.column("h").to_numpy()
                batch = batch.filter(pa.array(_let_through(bits, h) & ~np.isin(h, others)))
            for *key, doc, passage in zip(*(batch.column(c).to_pylist() for c in ("h", "s1", "s2", "doc_id")), batch.column("passage")):
                found = seen.get(tuple(key))
                if found is None:
                    seen[tuple(key)] = [doc, text := passage.as_py()]
                    size += len(text) + 200
                else:
                    found[0] = min(found[0], doc)
            if size > HELD_BYTES:
                yield made(seen)
                seen, size = {}, 0
        if seen:
            yield made(seen)

    chosen = passages.select("h", "s1", "s2", "doc_id", "passage")
    return (chosen if few else chosen.join(anchors.select("h"), "h", "left_semi")).mapInArrow(once, "h long, s1 long, s2 long, least long, passage binary")


def first_documents(passages: DataFrame, length: int, passage_cap: int, row_cap: int, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(h, s1, s2, firsts) for each distinct passage of an anchor: the least id that has each of its windows."""
    distinct = cut(passages.groupBy("h", "s1", "s2").agg(F.min("doc_id").alias("least"), F.min("windows").alias("windows"), F.count("*").alias("met")))
    sizes = cut(distinct.groupBy("h").agg(F.count("*").alias("n"), F.sum("met").alias("met")))
    few = (F.col("n") <= passage_cap) & (F.col("met") <= row_cap)
    some, hot = sizes.where((F.col("n") > 1) & few), sizes.where((F.col("n") > 1) & ~few)
    n_some, total = some.agg(F.count("*"), F.coalesce(F.sum("met"), F.lit(0))).first()
    n_hot = hot.count()
    alone = distinct.join(sizes.where("n = 1").select("h"), "h", "left_semi").select("h", "s1", "s2", F.array_repeat("least", F.col("windows")).alias("firsts"))
    schema = "h long, s1 long, s2 long, firsts array<long>"
    shards = max(1, -(-total // SHARD_ROWS))
    texts = _texts(passages, some, n_some, broadcast_anchors, hot, n_hot).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    out = alone.union(texts.groupBy("shard").applyInPandas(lambda rows: matched_passages(rows, length), schema))
    if not n_hot:
        return out

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, "passage", 256 << 10)):
            split = [x.split() for x in batch.column("passage").to_pylist()]
            texts = [b" ".join(w[i : i + length]) for w in split for i in range(len(w) - length + 1)]
            index = pa.array([n for n, w in enumerate(split) for _ in range(len(w) - length + 1)], pa.int64())
            at = pa.array([i for w in split for i in range(len(w) - length + 1)], pa.int32())
            hashes = [pa.array(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in texts), np.uint64, len(texts)).view(np.int64)) for seed in (3, 4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in ("h", "s1", "s2", "least")), at, *hashes], ["h", "s1", "s2", "least", "at", "w1", "w2"])

    each = _texts(passages, hot, n_hot, broadcast_anchors).mapInArrow(windows, "h long, s1 long, s2 long, least long, at int, w1 long, w2 long")
    # A very common window is spread over SALTS keys.
    least = each.groupBy("w1", "w2").agg(F.min("least").alias("first")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = each.drop("least").withColumn("salt", F.pmod("s1", F.lit(SALTS)).cast("int")).join(least, ["w1", "w2", "salt"]).groupBy("h", "s1", "s2").agg(F.sort_array(F.collect_set(F.struct("at", "first"))).alias("each"))
    return out.union(told.select("h", "s1", "s2", F.transform("each", lambda x: x["first"])))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, passage_cap: int = 1000, row_cap: int = 4000, broadcast_anchors: int = BROADCAST_ANCHORS) -> DataFrame:
    """(doc_id, n_words, n_removed, text) for each row, without the words of windows of ``length`` words
    that also start in a row of smaller id; the kept words are joined by one space.

    Ids are whole numbers; others raise a TypeError, as they need an order that the automata can hold. Null, empty and blank texts have no words. Rows that repeat an id are rows of
    their own and don't repeat each other; rows without an id are kept whole and are no reference. An
    empty table gives no rows. Columns other than id and text aren't read.
    """
    spark = docs.sparkSession
    slim = keyed(docs, id_col, text_col)
    kind = slim.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; whole numbers are needed")
    slim = slim.withColumn("doc_id", F.col("doc_id").cast("long"))
    path = f"{checkpoint_dir(spark)}/passages-{uuid.uuid4().hex}"
    reference_passages(slim.where("doc_id IS NOT NULL"), length, broadcast_anchors).write.mode("overwrite").option("compression", "zstd").parquet(path)
    passages = spark.read.parquet(path)
    told = first_documents(passages, length, passage_cap, row_cap, broadcast_anchors)
    mine = passages.select("doc_id", "key", "start", "h", "s1", "s2").join(told, ["h", "s1", "s2"])
    earlier = F.filter(F.transform("firsts", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    runs = mine.select("doc_id", "key", earlier.alias("starts")).where(F.size("starts") > 0).groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            kept, totals, gone = [], [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist()):
                words = (text or b"").split()
                edges = np.zeros(len(words) + 1, np.int64)
                if starts:
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.array(starts) + length, -1)
                stay = np.cumsum(edges[:-1]) == 0
                kept.append(b" ".join(words if stay.all() else [w for w, s in zip(words, stay) if s]))
                totals.append(len(words))
                gone.append(int((~stay).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    joined = slim.join(runs, ["doc_id", "key"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
