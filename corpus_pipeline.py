"""Corpus pipeline: quality, near duplicates, decontamination, personal data, byte-level tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as
Parquet in the shared folder and hands what it reads back to the next. All stages but
the last return the columns of documents.

Null and empty texts go through all stages: they have no words, no passages, no personal
data and no tokens; the classifier scores them like any text. Texts and their words may be
of any length. Rows that repeat a doc_id are one document to the near-duplicate stage,
which keeps the first by its text; rows without a doc_id stay. Ties go to the smaller
doc_id. Other columns, whatever their names, are kept up to the last stage. An empty table
gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from harrow.llm import bpe, decontam, minhash, pii, quality
from harrow.llm.common import documents, materialize


#: Pre-tokens that a worker remembers here: it shares its executor with what the stages before have left.
REMEMBERED = 30_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id."""
    return minhash.drop_duplicates(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(spark, docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the byte-level BPE ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ("n_tokens", "ids_sha256", "decoded_sha256"), REMEMBERED)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("byte_bpe", encode_tokens),
]

#: Learned weights, discovered patterns and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
