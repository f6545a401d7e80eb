"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from tidemark.llm.queries import SHARDS, table
from tidemark.llm.quality import fold
from tidemark.llm.shared import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; null and empty texts and repeated rows stay. An empty table gives no rows; columns keep their
    names and values, whatever they are called. So do those of the stages that follow."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 5) != 0)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, of equal rows one; null texts all stay."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too large a share of benchmark passages go; null and empty texts and repeated rows stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by calibrated probabilities towards the target mixture; null and blank texts, which have no tokens, go. Repeated rows
    stay or go together."""
    return mixing.sample(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and place in it: null keys and texts too, repeated rows one by one; other columns go."""
    return sharding.shard_records(docs, [1.0] * SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: The toxicity stage learns weights from labels, which SQL cannot express. tests/llm/test_pipeline.py replays run() stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
