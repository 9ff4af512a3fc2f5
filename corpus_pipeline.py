"""The corpus pipeline: classify, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its result is
written as Parquet and read again as the next stage's docs.  An empty table stays empty,
other columns may have any names and stay as they are, repeated rows fare alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenstep.llm import decontaminate, mixing, near_dedup, ordinal, queries, sharding
from lumenstep.llm._common import shared_dir

SHARDS = 16


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the ordinal classifier rates below the top grade; a null text is judged as an empty one."""
    return ordinal.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates; null ids and wordless texts stay."""
    return near_dedup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark; null texts hold none."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents as the mix of sources takes them, better rated ones first; null is a source of its own."""
    rated = queries.ratings(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.repeated(docs, rated, queries.GOOD, queries.POOR)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give each document its shard; nulls count as values, a column `shard` is replaced."""
    return sharding.placed(docs, SHARDS)


STAGES = [("classify", classify), ("deduplicate", deduplicate), ("decontaminate", decontaminated), ("mix", mix), ("shard", shard)]
#: A trained model takes part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
