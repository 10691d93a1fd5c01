"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

Counted as part of the training-data subpackage. Every stage works on all that
its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import ARROW_BATCH, read_table, written
from marlstone.llm.decontamination import remove_contamination
from marlstone.llm.ngram_join import keep_one_per_component
from marlstone.llm.packing import pack, token_pieces
from marlstone.llm.pii import redact
from marlstone.llm.quality_rules import keep_documents


def _small_batches(spark: SparkSession) -> None:
    """Python workers of this job get small batches, as their memory is an executor's too."""
    for key, value in ARROW_BATCH.items():
        spark.conf.set(key, value)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the default policy go."""
    _small_batches(spark)
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard of 0.8 or more on 5-word shingles the smallest id stays."""
    return keep_one_per_component(docs, n=5, threshold=Fraction(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that consist of them by half or more go."""
    _small_batches(spark)
    return remove_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return pack(token_pieces(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can express neither the tokenizer nor the fitted spans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
