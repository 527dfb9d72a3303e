"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the
columns of `documents`; the last returns the packed pieces. Stages whose texts go to Python when the caller runs
what they return leave the session with small Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from autolot.llm import mixing, neardup, packing, private, quality
from autolot.llm.common import keep_batches_small, materialize, quoted, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits and the learned quality rules keep."""
    keep_batches_small(spark)
    return quality.keep_good(spark, docs, sf_dir)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    keep_batches_small(spark)
    return private.redact(docs, private.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, and shuffled."""
    return mixing.mix(docs).select(*map(quoted, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("near-duplicates", deduplicate), ("personal data", redact), ("mixing", mix), ("packing", pack)]

#: SQL cannot express learned rules, signatures or tokens; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs
