"""A training corpus from ``documents``: classified, deduplicated, decontaminated, mixed and sharded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sagaframe.llm import decontaminate, mixing, nearcopies, quality, sharding
from sagaframe.llm.common import checkpoint_dir


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), the one with the smallest id."""
    return nearcopies.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents as often as the mixture of their sources takes them."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the documents with the run and shard that hold them."""
    return sharding.shard(docs, f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}")


STAGES = [("quality classifier", classified), ("near duplicates", deduplicated), ("benchmark decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: The classifier's stage can't be expressed in SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written as Parquet and read again as the next one's."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
