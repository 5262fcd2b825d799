"""The corpus pipeline: STAGES in order, each stage's rows written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, in their
order, whatever further columns there are and however they are named. Stages take an empty table to an empty one, read
texts of any length whole, and never drop a row for a null outside `text` and `doc_id`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import exact_dedup, minhash_dedup, packing, pii, toxicity
from gridloom.llm.shared import discard, materialise, small_batches


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 by a lexicon learnt from the labels of the query's training fold.

    Null, empty and unmatched texts score 0 and stay, as do rows without doc_id; repeated rows are scored alike. Without
    labels, or without toxic ones, the lexicon is empty and all rows stay. A document with several labels is toxic if
    one says so.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, toxicity.train_rows(labels)))


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id.

    Texts are equal after white space is normalised; null is empty, so one of all null, empty and blank texts (" " is not
    empty, but equals any other blank one) stays. Rows that repeat both doc_id and text of the one that stays do too;
    of rows without doc_id, all stay whose text no row with one has.
    """
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    Null, empty and blank texts have no shingles and stay, rows without doc_id too. Rows that repeat doc_id and text share
    their fate; where a doc_id stands before several texts, each row is judged by its own.
    """
    small_batches(spark)
    return minhash_dedup.minhash_dedup(docs)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms under the session's key (`pii.SETTING`).

    Null stays null and empty empty; all rows stay, repeated ones and those without doc_id too; only text changes.
    """
    small_batches(spark)
    return pii.pseudonymise(docs, pii.key_of(spark))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens.

    A null or empty text is one piece, the end token; repeated rows are packed once each, rows without doc_id too.
    """
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", stage_toxicity),
    ("exact_dedup", stage_exact_dedup),
    ("near_dedup", stage_near_dedup),
    ("pii", stage_pii),
    ("packing", stage_packing),
]

#: SQL can express neither a learnt lexicon nor token packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
