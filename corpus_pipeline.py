"""A cleaning pipeline over ``documents``: each stage calls one operator of the llm subpackage.

toxicity drops the documents that the classifier rejects; ngram_jaccard keeps the smallest doc_id of each class of near
copies, row by row where ids repeat; decontamination drops documents that contain a test item; secret_scan replaces secrets in the texts that stay,
and their n_chars follows; sentencepieces encodes the texts. Every stage works on all its predecessor kept and, but for
the last, returns the columns of documents.

Defined results: null texts count as empty and stay null where a stage returns them; they are neither toxic, nor copies,
nor contaminated. A row without doc_id is a document like any other. Empty input gives empty output. Columns besides those of documents are not returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sieveworks.llm import decontamination, jaccard, secret_scan, sentencepieces, toxicity
from sieveworks.llm.common import fresh_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts stay."""
    classifier = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.kept(docs, classifier).select(*COLUMNS)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the smallest doc_id, or one without; texts without words all stay."""
    return jaccard.deduplicated(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item; items of fewer than five words match nothing."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with [SECRET] for secrets, and the n_chars of what is left; null texts keep theirs."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the same documents' pieces; null and empty texts have none."""
    return sentencepieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepieces", encode_pieces),
]

#: Several stages are models or searches that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
