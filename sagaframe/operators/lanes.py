"""Greedy folds over ordered intervals: lanes, first fits, colours, cursors.

Each decision needs all earlier ones, which no built-in expresses without gathering a group in an
array. So rows are dealt by their keys, sorted inside the partitions (Spark spills that) and streamed
through a small state in Arrow batches: groups of any size fit, as the state of a group holds only
its open intervals. ``first_fit``, whose order isn't that of the starts, holds a connected island of
intervals. Where islands can't tell of each other, in ``pack`` and ``first_fit``, each island of a key with
over ``hot`` rows is a group of its own, so that such a key goes over many tasks; colours and cursors are
carried from island to island, and there one key's rows pass through one task, in order.

Bounds are whole numbers a <= b; rows without a bound stay, without a result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagaframe.operators.intervals import islands
from sagaframe.session import cut as _cut

#: Rows of a key from which on its islands are dealt apart.
HOT = 100_000


class _Packing:
    """Lanes that are busy until an end, and the numbers of free ones."""

    def __init__(self, touching: bool):
        self.touching, self.busy, self.free, self.n = touching, [], [], 0

    def step(self, a: int, b: int) -> tuple:
        while self.busy and (self.busy[0][0] < a or self.touching and self.busy[0][0] == a):
            heappush(self.free, heappop(self.busy)[1])
        if not self.free:
            heappush(self.free, self.n)
            self.n += 1
        lane = heappop(self.free)
        heappush(self.busy, (b, lane))
        return (lane,)


class _FirstFit:
    """The intervals of each lane. None overlap, so in the order of starts their ends rise too."""

    def __init__(self):
        self.lanes: list[tuple[list, list]] = []

    def step(self, a: int, b: int) -> tuple:
        for lane, (placed, ends) in enumerate(self.lanes):
            at = bisect_right(ends, a)  # the first that ends behind the start
            if at == len(placed) or placed[at][0] >= b:
                break
        else:
            lane, (placed, ends) = len(self.lanes), ([], [])
            self.lanes.append((placed, ends))
        insort(placed, (a, b))
        insort(ends, b)
        return (lane,)


class _Colouring:
    """Open intervals with their slots, and the last slot of each lane."""

    def __init__(self, slots: int):
        self.slots, self.open, self.last = slots, [], {}

    def step(self, a: int, b: int, lane: int) -> tuple:
        while self.open and self.open[0][0] < a:
            heappop(self.open)
        taken = {slot for _, start, slot in self.open if start <= b} | {self.last.get(lane)}
        slot = next((s for s in range(1, self.slots + 1) if s not in taken), lane % self.slots + 1)
        heappush(self.open, (b, a, slot))
        self.last[lane] = slot
        return (slot,)


class _Cursor:
    def __init__(self):
        self.at = None

    def step(self, a: int, b: int) -> tuple:
        start = float(a) if self.at is None else max(float(a), self.at)
        self.at = float(b) if b > start else start + 0.5
        return start, self.at


def _folded(df: DataFrame, keys: list[str], order: list[Column], begin: Callable, results: dict[str, str], given: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, a, b, results): the rows of each group in order through a state that ``begin`` makes; ``given`` are further columns of its steps."""
    places = [F.col(c).cast("long").alias(c) for c in ("id", "a", "b", *given)]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *places)
    kinds = {"long": pa.int64(), "double": pa.float64()}
    nothing = (None,) * len(results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            groups = zip(*(batch.column(i).to_pylist() for i in range(len(keys))))
            for group, row in zip(groups, zip(*(batch.column(c).to_pylist() for c in ("a", "b", *given)))):
                if state is None or group != held:
                    held, state = group, begin()
                out.append(nothing if None in row else state.step(*row))
            made = [pa.array(x, kinds[kind]) for x, kind in zip(zip(*out) if out else [()] * len(results), results.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 3], *made], [*batch.schema.names[: len(keys) + 3], *results])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys) + 3])
    return rows.mapInArrow(run, ", ".join([fields, *(f"{c} {kind}" for c, kind in results.items())]))


def _apart(df: DataFrame, keys: list[str], touching: bool, hot: int) -> DataFrame:
    """``df`` with ``_island``, null where a key has no more than ``hot`` rows."""
    rows = df.withColumn("_key", F.struct(*keys))
    many = _cut(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("_key"))
    if many.isEmpty():
        return df.withColumn("_island", F.lit(None).cast("long"))
    calm = rows.join(many, "_key", "left_anti").drop("_key").withColumn("_island", F.lit(None).cast("long"))
    return calm.unionByName(islands(rows.join(many, "_key", "left_semi").drop("_key"), keys, "_island", touching))


def pack(df: DataFrame, keys: list[str], touching: bool = True, hot: int = HOT) -> DataFrame:
    """(keys, id, a, b, lane): by start, the longer first, into the lowest lane that is free.

    A lane is free if its last end is before the start, or, with ``touching``, on it. So at the beginning of
    an island all are.
    """
    apart = _apart(df, keys, touching, hot)
    return _folded(apart, [*keys, "_island"], [F.asc("a"), F.desc("b"), F.asc("id")], lambda: _Packing(touching), {"lane": "long"}).drop("_island")


def pack_blocks(df: DataFrame, keys: list[str], block: str, touching: bool = True, hot: int = HOT) -> DataFrame:
    """(keys, block, id, a, b, lane): each block packed by itself, its lanes behind those of the smaller blocks of its key."""
    packed = _cut(pack(df, [*keys, block], touching, hot).withColumn("_key", F.struct(*keys)).withColumn("_own", F.struct(block)))
    used = packed.groupBy("_key", "_own").agg((F.max("lane") + 1).alias("_n"))
    w = Window.partitionBy("_key").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    before = used.select("_key", "_own", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return packed.join(before, ["_key", "_own"]).select(*keys, block, "id", "a", "b", (F.col("lane") + F.col("_before")).alias("lane"))


def first_fit(df: DataFrame, keys: list[str], priority: str, hot: int = HOT) -> DataFrame:
    """(keys, id, a, b, lane): in order of ``priority``, into the first lane where every interval ends by the start or starts by the end.

    In a hot key, intervals behind the end of all earlier ones begin a new island, which is filled by itself.
    """
    apart = _apart(df, keys, True, hot)
    return _folded(apart, [*keys, "_island"], [F.asc(priority), F.asc("id")], _FirstFit, {"lane": "long"}).drop("_island")


def colour(df: DataFrame, keys: list[str], slots: int = 8) -> DataFrame:
    """(keys, id, a, b, slot) from packed lanes: the lowest slot from 1 on that no earlier overlapping interval
    and not the previous one of the lane has; where none is left (lane mod slots) + 1."""
    return _folded(df, keys, [F.asc("a"), F.desc("b"), F.asc("id")], lambda: _Colouring(slots), {"slot": "long"}, ("lane",))


def cursor(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, a, b, start, stop): each interval starts no earlier than the one before stops; empty ones get half a unit."""
    return _folded(df, keys, [F.asc("a"), F.asc("b"), F.asc("id")], _Cursor, {"start": "double", "stop": "double"})
