"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of each document go through random Fourier features, which approximate a Gaussian kernel.
Partitions sum the normal equations of their labelled rows; the sums, of a size fixed by the number
of features, are solved on the driver. Training scores are counted by bins of a fixed grid and made
monotone there by pooling adjacent violators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagaframe.llm.common import cut, portions

FEATURES, SEED, BINS = 128, 7, 1000
#: Documents that a model is fitted on at most; they are few enough to broadcast their ids.
FIT_ROWS = 50_000
STATISTICS = ("log_words", "mean_chars", "deviation_chars", "distinct_words", "distinct_triples", "top_word", "upper", "digits", "symbols", "exclamations", "points", "not_ascii", "repeated_lines", "log_line_words")


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(of)] = 1
    return out


_CLASSES = np.stack([_table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"#*$%&|<>"), _table(b"!"), _table(b".,;:?"), _table(bytes(range(128, 256)))], 1)


def statistics(text: bytes | None) -> list[float]:
    """The STATISTICS of a UTF-8 text, all zero without words."""
    found = (text or b"").split()
    if not found:
        return [0.0] * len(STATISTICS)
    n, lengths = len(found), np.fromiter(map(len, found), np.int64, len(found))
    counts, triples = Counter(found), set(zip(found, found[1:], found[2:]))
    lines = [x for x in text.split(b"\n") if x]
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / lengths.sum()
    return [np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, len(triples) / max(1, n - 2), max(counts.values()) / n, *shares, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines))]


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            made = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "x"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Model:
    """Scores statistics; without any label every score is 1, as nothing speaks against a document."""

    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: np.ndarray | None = None  # the calibrated score of each bin's middle

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        directions, phases = rng.normal(0, 1 / 3, (x.shape[1], FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(x):
            return np.ones(len(x))
        middles = -0.5 + (np.arange(BINS) + 0.5) * 2 / BINS
        return np.interp(self.raw(x), middles, self.steps)


def isotonic(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """A rising score for each bin: pooled adjacent violators, and between them lines."""
    blocks: list[list[float]] = []  # sum, count, first and last bin
    for i in np.flatnonzero(counts):
        blocks.append([sums[i], counts[i], i, i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    ends = [(i, s / n) for s, n, a, b in blocks for i in ((a, b) if b > a else (a,))]
    return np.clip(np.interp(np.arange(len(counts)), *zip(*ends)), 0, 1)


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), float).reshape(len(pdf), len(STATISTICS))


def fit(labelled: DataFrame, ridge: float = 1e-3) -> Model:
    """A model from (x, y), y 0 or 1."""
    k = len(STATISTICS)
    each = [F.get("x", F.lit(i)) for i in range(k)]
    row = labelled.agg(F.count("*"), *(F.avg(x) for x in each), *(F.stddev_pop(x) for x in each)).first()
    if not row[0]:
        return Model()
    model = Model(np.array(row[1 : k + 1]), np.maximum(np.array(row[k + 1 :]), 1e-6))
    size = FEATURES + 1
    upper = np.triu_indices(size + 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for pdf in batches:
            z = np.hstack([model.features(_rows(pdf)), pdf["y"].to_numpy(float)[:, None]])
            total += z.T @ z
        yield pd.DataFrame({"at": np.arange(len(upper[0])), "v": total[upper]})

    total = np.zeros((size + 1, size + 1))
    for at, v in labelled.mapInPandas(sums, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        total[upper[0][at], upper[1][at]] = v
    gram = total[:size, :size] + np.triu(total[:size, :size], 1).T
    model.weights = np.linalg.solve(gram + ridge * row[0] / FEATURES * np.eye(size), total[:size, size])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bin": np.minimum(((model.raw(_rows(pdf)) + 0.5) * BINS / 2).astype(int), BINS - 1), "y": pdf["y"]})

    counts, ones = np.zeros(BINS), np.zeros(BINS)
    for at, n, s in labelled.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.count("*"), F.sum("y")).collect():
        counts[at], ones[at] = n, s
    model.steps = isotonic(counts, ones)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fitted_on(ids: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id): the ids that the model is fitted on: not held out, with a quality label, the first ``rows`` of them in hash order."""
    known = ids.where(~held_out(F.col("doc_id"))).join(labels.where(F.col("quality").isin(0, 1)).select("doc_id"), "doc_id", "left_semi").distinct()
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def trained(table: DataFrame, labels: DataFrame) -> Model:
    """The model fitted on the rows of ``described`` with the ids of ``fitted_on``."""
    known = cut(fitted_on(table.select("doc_id"), labels))
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("double").alias("y"))
    return fit(cut(table.join(F.broadcast(known), "doc_id").join(marks, "doc_id").select("x", "y")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Null, empty and blank texts have statistics of zero and are scored like others. Labels that are null
    or neither 0 nor 1 don't count; at most FIT_ROWS documents are fitted on; a document with several labels, or rows that repeat an id, count once
    for each. Without usable labels every score is 1. An empty table gives no rows. Columns of ``docs``
    other than id and text aren't read.
    """
    table = cut(described(docs, id_col, text_col))
    model = trained(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(len(batch), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    scored = table.mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with the same columns, whose score reaches the threshold; no shuffle of texts.

    Rows are scored as by ``classify``, and only those that the model is fitted on are described twice.
    """
    known = fitted_on(docs.select(F.col(id_col).alias("doc_id")), labels)
    chosen = docs.join(F.broadcast(known.select(F.col("doc_id").alias(id_col))), id_col, "left_semi")
    model = trained(cut(described(chosen, id_col, text_col)), labels)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, text_col)):
            made = [statistics(x.as_py()) for x in batch.column(place).cast(pa.binary())]
            x = np.array(made, float).reshape(len(batch), len(STATISTICS))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
