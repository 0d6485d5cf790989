"""A corpus cleaning pipeline: each stage calls one operator of tessera.llm and its decisions take effect.

In every stage texts of any length count whole, an empty table gives an empty one, rows decide for themselves whatever
other rows of the same doc_id (or of none) hold, and columns beside doc_id and text pass through whatever their names
and nulls; the last stage returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, pieces, recompress, toxicity
from tessera.llm.common import remove_temporary, table, temporary_tables, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  Null and empty texts have the score of the bias; repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id (null first) stays; of repeated rows one.  Texts without words all stay."""
    return jaccard.one_of_each_group(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that occurred before are cut out; every document stays, and null and empty texts are as they were."""
    return recompress.dedup_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.  Null and empty texts hold none; null and empty items are never found."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as tokens: doc_id, n_tokens, ids_sha256, round_trip.  Null and empty texts have no tokens; repeated rows and null ids stay."""
    return pieces.encode_digest(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding and decoding", token_stage),
]

#: SQL cannot express the trained classifier of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    start = temporary_tables()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        remove_temporary(spark, start, temporary_tables() - 1)  # only the stage's result is read from here on
    return STAGES[-1][1](spark, docs, sf_dir)
