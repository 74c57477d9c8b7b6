"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes all that its predecessor kept and returns the columns of documents; the last one adds where
each document went.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrerylake.llm import decontaminate, mixing, quality_rules, sharding, simhash
from orrerylake.llm.common import free_name, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where(F.col(free_name(docs, "kept"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, a similarity of 0.8 or more."""
    return simhash.drop_similar_texts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target weights of sources, languages and topics."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left goes to a shard and a slot in it."""
    return sharding.shard(docs, keep=docs.columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("sharding", shards),
]

#: The quality rules are learned and the near-duplicates are components, neither of which SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, "pipeline")
    return docs
