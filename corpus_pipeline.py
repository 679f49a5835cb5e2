"""The training-corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the
stage before it kept; all but the last return the columns of ``documents``.
``run`` writes every stage to the shared folder and reads it back, so a lost
executor costs the current stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import stash, table
from quire.llm.decontamination import drop_contaminated
from quire.llm.mixing import mixed_documents
from quire.llm.queries import training_labels
from quire.llm.sharding import assign_shards
from quire.llm.simhash_dedup import drop_near_copies
from quire.llm.toxicity import fit_toxicity, reject_toxic
from quire.session import ship_package

SHARDS = 40


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar does not call toxic; like op5 it learns
    from the labels outside of the held-out fold."""
    ship_package(spark)
    return reject_toxic(docs, fit_toxicity(docs, training_labels(table(spark, sf_dir, "labels"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    ship_package(spark)
    return drop_near_copies(docs, width=3, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    ship_package(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    ship_package(spark)
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document copy."""
    ship_package(spark)
    placed = assign_shards(docs, SHARDS)
    return placed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# learned weights, bit fingerprints and hypergeometric draws are not SQL;
# tests/llm checks the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
