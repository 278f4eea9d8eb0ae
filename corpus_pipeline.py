"""A training corpus from raw documents: filter, filter, deduplicate, mask, pack.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows that the stage before
it kept, and all but the last return the columns of ``documents``.  ``sf_dir`` is only
read for ``labels``.  Null texts count as empty, and null ids stay null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import packing, quality, secrets, simhash, toxicity
from lodestar.llm.common import free_name, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good is at least one half; null and empty texts are judged as empty."""
    model = quality.train(quality.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    name = free_name(docs, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).drop(name)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under 0.3; null and empty texts are judged as empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.3).drop(name)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, a row without an id only where none has one."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with secrets masked, and ``n_chars`` of the masked text."""
    masked = secrets.redact(docs, secrets.train(docs))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))) if "n_chars" in docs.columns else masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of 4,096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: Trained models, XXH64 fingerprints and a tokenizer have no SQL form; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)  # written as Parquet and read again
    return docs
