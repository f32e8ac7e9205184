"""From raw documents to packed training sequences: quality, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents;
the last returns the pieces, their token ids and their places. Models are trained here, on what the stage is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import decontamination, near_dedup, packing, pii, quality_classifier
from quillon.llm.common import written

#: Bytes of rows that the JVM sends to a Python worker at once. Both hold a batch several times over; no result depends on where batches end.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Hold this session's Arrow batches to BATCH_BYTES, whatever the documents' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality label is 1."""
    in_small_batches(spark)
    return quality_classifier.good_rows(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    in_small_batches(spark)
    return near_dedup.without_near_duplicates(spark, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    in_small_batches(spark)
    return decontamination.clean_rows(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and disclosing terms replaced."""
    return pii.sanitised_rows(spark, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, and their places in sequences of 2048 tokens."""
    in_small_batches(spark)
    return packing.pack(spark, docs, ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("personal_data", personal_data), ("packing", packed)]

#: Learned models and branch and bound are beyond SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
