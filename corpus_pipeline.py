"""The corpus pipeline: each stage works on what its predecessor kept and is written and read again before the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents; the last returns the mix's counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandkit.llm import decontamination, mixing, secrets, similarity, toxicity
from strandkit.llm.common import table
from strandkit.session import drop_path, shared_dir


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class of near-duplicates: five words, similarity 0.8."""
    return similarity.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; keeps every document."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Trained stages have no SQL; tests/llm holds the rows of the chained stages against a plain Python version that shares the fitted models.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again, and removed once the next is
    written. What remains is the last one's, which the caller reads."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{base}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            if last:
                drop_path(spark, last)
            docs, last = spark.read.parquet(path), path
    except BaseException:
        drop_path(spark, base)
        raise
    return docs
