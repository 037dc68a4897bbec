"""A training-text pipeline of five stages over documents.

Every stage is written as Parquet to the shared folder and read again as the next one's
input, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veridat.llm import op5_decontaminate, op6_jaccard, op7_quality, op8_secrets, op10_mixing
from veridat.llm.common import fresh_path, removed

BATCH = "4m"  # of texts that reach Python at once; with Spark's 10,000 rows, an executor holds some batches of 33 MB and more


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` in a session whose Arrow batches are of BATCH, whatever the length of texts."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, and so do documents that lose too much or fail the base rules."""
    return op7_quality.judge(docs, keep_columns=True)


@in_small_batches
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return op6_jaccard.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return op5_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text."""
    return op8_secrets.scan(docs, op8_secrets.train(docs), redact="[secret]")


@in_small_batches
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its rate; those with rate zero go."""
    return op10_mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # read for the last time
            removed(spark, before)
        before = path
    return docs
