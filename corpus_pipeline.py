"""The training-data pipeline: quality rules, language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given.  All but the last return the columns of ``documents``; the last returns the packing
plan of the documents that are left.  ``run`` stores what each stage returns and hands the stored rows to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import materialise, table
from topicloom.llm.language import keep_identified, train_filter
from topicloom.llm.packing import pack
from topicloom.llm.pii import sanitise
from topicloom.llm.quality import clean_documents
from topicloom.llm.simhash import drop_near_duplicates


BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """Whole documents are long rows: smaller Arrow batches keep the buffers of executors and workers small in every stage."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that lose too much or fail the base rules."""
    _small_batches(spark)
    return _counted(clean_documents(docs))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in none of the languages learned from the labelled ones."""
    _small_batches(spark)
    return keep_identified(docs, train_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: shingles of 3 words, at most 3 differing bits."""
    _small_batches(spark)
    return drop_near_duplicates(docs, shingle_words=3, max_bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are masked, terms that reveal them generalised or removed."""
    _small_batches(spark)
    return _counted(sanitise(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left."""
    return pack(docs, buckets=16, token_budget=16_384)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Hashed fingerprints and corpus statistics have no SQL form; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
