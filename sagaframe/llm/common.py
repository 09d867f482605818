"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagaframe.session import shared_folder

#: Words are maximal runs of anything but space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only in local mode (tests)."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """The words of a text (null: none) as an array of strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id, text as bytes, and ``key``, which tells rows of one id with different texts apart."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).cast("binary").alias("text"))


def portions(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of a column each (or one row), so that a task holds no more at once."""
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(batch):
        yield batch.slice(start)
