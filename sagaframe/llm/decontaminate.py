"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by an error budget of k edits. Cut into k + 1 pieces, at least
one piece of it stands in such a passage unchanged, so documents are searched for all pieces at once
and only the places of hits are verified, with Myers' bit-parallel edit distance. Items go out in
blocks of bounded size; for each block the documents are read once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import portions

#: A matcher takes some 55 times the bytes of its block, so about 110 MB.
BLOCK_BYTES, MIN_PIECE = 2 << 20, 8


def normal(text: str) -> str:
    """Lower case, and one space for each run of white space."""
    return " ".join(text.lower().split())


def budget(length: int, error_rate: float) -> int:
    """Edits allowed for an item, so few that no piece is shorter than MIN_PIECE."""
    return max(0, min(int(length * error_rate), length // MIN_PIECE - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of about the same length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str) -> tuple[int, int]:
    """The least edit distance between ``item`` and a substring of ``text``, and where the first such ends (Myers 1999)."""
    m, masks = len(item), defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text, 1):
        same = masks.get(c, 0)
        vertical, horizontal = same | minus, (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        score += bool(up & top) - bool(down & top)
        if score < best[0]:
            best = score, at
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[str], error_rate: float):
        self.items, self.budgets = items, [budget(len(x), error_rate) for x in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(items):
            for offset, piece in pieces(item, self.budgets[i]):
                at[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end) of each item within its budget somewhere in a normalised text."""
        starts: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                starts[i].add(last + 1 - length - offset)
        out = []
        for i, found in starts.items():
            k, best, reach = self.budgets[i], None, len(self.items[i]) + self.budgets[i]
            merged: list[list[int]] = []
            for a, b in ((max(0, s - k), s + reach) for s in sorted(found)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            for a, b in merged:
                distance, end = best_match(self.items[i], text[a:b])
                if distance <= k and (best is None or distance < best[0]):
                    best = distance, a + end
            if best:
                out.append((i, *best))
        return out


@lru_cache(maxsize=1)
def _matcher(items: tuple[str, ...], error_rate: float) -> Matcher:
    return Matcher(list(items), error_rate)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list]]]:
    """The distinct normalised texts with the ids that have them, as many at once as BLOCK_BYTES holds."""
    seen, size = defaultdict(list), 0
    for row in items.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull()).orderBy(text_col).toLocalIterator():
        if text := normal(row[1]):
            size += 0 if text in seen else len(text.encode())
            seen[text].append(row[0])
            if size >= BLOCK_BYTES:
                yield list(seen.items())
                seen, size = defaultdict(list), 0
    if seen:
        yield list(seen.items())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05) -> DataFrame:
    """(doc_id, item_id, distance, budget) for each row of ``docs`` and each item that it holds within the item's budget.

    Case and the kind of white space don't count. Null and blank texts and items match nothing; items of
    equal text each have their rows, as have rows of ``docs`` that repeat an id. Without documents or
    items there are no rows. Columns other than the ids and texts aren't read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = slim.schema["doc_id"].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, distance int, budget int"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast((tuple(x for x, _ in block), [ids for _, ids in block]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            texts, item_ids = held.value
            matcher = _matcher(texts, error_rate)
            for batch in (part for whole in batches for part in portions(whole)):
                hits = [(n, *hit) for n, text in enumerate(batch.column(1)) if text.is_valid for hit in matcher.find(normal(text.as_py()))]
                rows = [(n, item, d, matcher.budgets[i]) for n, i, d, _ in hits for item in item_ids[i]]
                columns = [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows]) if rows else pa.array([], pa.int64()), *(pa.array([r[j] for r in rows], pa.int32()) for j in (2, 3))]
                if rows:
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "distance", "budget"])

        out = out.union(slim.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05) -> DataFrame:
    """The rows of ``docs``, with the same columns, whose text holds no item within its budget.

    Each row is judged by its own text, with or without an id, in the task that reads it: nothing is
    shuffled. A row goes with the first block of items that it holds one of. Blocks are steps of one task,
    each with a worker of its own, so that a task's memory grows with the items, by 110 MB for each block.
    """
    out = docs
    for block in _blocks(items, item_id_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(tuple(x for x, _ in block))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held.value, error_rate)
            for batch in (part for whole in batches for part in portions(whole, text_col)):
                clean = [not text.is_valid or not matcher.find(normal(text.as_py())) for text in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
