"""The training-data pipeline over ``documents``: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daystrata.llm import decontamination, mil, mixing, resemblance, secrets
from daystrata.llm.catalog import small_batches, table
from daystrata.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled ones among ``docs``."""
    small_batches(spark)
    model = mil.fit(docs, table(spark, sf_dir, "labels"))
    return docs.filter(mil.scored(model, docs) >= mil.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the one with the smallest doc_id."""
    small_batches(spark)
    return resemblance.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of the benchmark."""
    small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a placeholder."""
    small_batches(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: copies of the documents with their epoch, block and place in the block."""
    return mixing.mixed(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]
#: Not expressible: the first stage is a trained model. tests/llm/test_pipeline.py compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
