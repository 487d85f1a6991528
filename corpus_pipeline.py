"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all that its predecessor kept; all but the last return the columns of
``documents``.  The tables besides the documents are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whence.llm import decontaminate, ngram_join, pii, sentencepieces, toxicity
from whence.llm.common import fold, free_name, prepare, table
from whence.llm.queries import DECIDE, PII_KEY, piece_model
from whence.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the decision, learned as in the registered query."""
    prepare(spark)
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", learn=fold(F.col("doc_id"), 3) != 1)
    return toxicity.clean(docs, weights, DECIDE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of their 5-word shingles), the one with the smallest doc_id."""
    prepare(spark)
    return ngram_join.representatives(docs, words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; n_chars follows the text."""
    prepare(spark)
    kinds = free_name(docs, "pii")
    changed = pii.pseudonymised(docs, PII_KEY, out=kinds).drop(kinds)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids and the text these decode to."""
    prepare(spark)
    return sentencepieces.round_trip(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_copies),
    ("decontamination", drop_leaks),
    ("pii", hide_private),
    ("sentencepiece", encode),
]

#: Learned scores and the library's pieces are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
