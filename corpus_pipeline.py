"""A training-corpus pipeline over `documents`: toxic and foreign texts go, one of each group of near copies stays, personal
data is replaced, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import bpe, langid, ngram_join, packing, pii, toxicity
from strandframe.llm.common import shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learned from `labels` does not find toxic; texts of any length are scored whole, null and empty ones stay
    unless the classifier finds the empty text toxic. Repeated rows fare alike, null ids stay, extra columns are kept, no rows give none."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language one of the models learned from them accepts; texts without a letter, null and empty ones go, repeated rows fare
    alike, null ids and extra columns stay, no rows give none."""
    return langid.reject(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of five-word shingles join at four fifths; those without words have no
    links and stay. Of rows that repeat an id one stays; rows without an id, which nothing tells apart, all stay; no rows give none."""
    return ngram_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind and n_chars set anew; null texts stay null with 0 characters, texts of any
    length are searched whole, repeated rows and extra columns stay."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens: null and empty texts are their end token alone, long ones are cut,
    repeated rows are packed as often as they come; no rows give none."""
    return packing.pack(docs, bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]
#: SQL has neither the trained classifiers nor the packing; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
