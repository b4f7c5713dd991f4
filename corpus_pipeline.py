"""A training corpus from documents: clean, deduplicate, mix and pack.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what a stage returns to the
shared folder and gives it to the next one. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyedflow.llm.common import store
from keyedflow.llm.exact_dedup import exact_dedup
from keyedflow.llm.mixing import mixed
from keyedflow.llm.near_dedup import without_near_copies
from keyedflow.llm.packing import pack, pieces
from keyedflow.llm.toxicity import keep_clean, train


#: Rows that go to a Python worker at a time. Whole texts are many bytes, and both sides hold a batch.
BATCH_ROWS = 1000


def _by_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labels of these documents, doesn't reject."""
    _by_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return keep_clean(docs, train(docs.select("doc_id", "text"), labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs, carry=docs.columns, only_kept=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    _by_batches(spark)
    return without_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    _by_batches(spark)
    return pack(store(pieces(docs)))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: A trained model and similarity sketches have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
