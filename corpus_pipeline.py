"""A training-data pipeline of five of the operators. run() applies STAGES to documents, each on what its predecessor kept.

Defined results: a document with a null or empty text is judged by the classifier like any other, takes no part in near-dedup, holds
no secrets and is never in the mix; a null id has no near-duplicates; of repeated rows one stays; texts of any length are taken
whole; stages carry columns of any name along, and run() reads the five columns of documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import public_vocabulary, token_digests
from tidemark.llm.common import materialize, spread, table
from tidemark.llm.minhash_dedup import keep_one
from tidemark.llm.mixing import mix_documents
from tidemark.llm.quality import keep_good
from tidemark.llm.secret_scan import redact_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of docs, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by 0.8 of their shingles of five words."""
    return keep_one(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken twice is there twice."""
    return mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of each document, decoded again."""
    return token_digests(docs, *public_vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("secret_scans", secret_scans),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: The classifier, signatures, the draw and the merges aren't expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
