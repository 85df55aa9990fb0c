"""A corpus pipeline: five stages from the documents table to encoded training data.

Every stage takes the columns of documents in any order, with any further columns whatever
their names, and all but the last return them unchanged.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlab.llm import exact_dedup, mixing, pieces, simhash, toxicity
from spanlab.llm.common import Passing, discard, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the toxicity model rejects go.

    Without labels none goes.  Rows that repeat go or stay together; a null or empty text has
    the score of the model's bias alone.  An empty table gives an empty one.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each text stays, the one with the smallest doc_id.

    A null doc_id comes last, and ties go by the other columns.  Empty texts equal each
    other, and so do null ones, so one of each stays.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near copies stays, the one with the smallest doc_id.

    Rows with a null doc_id or without any word stay.  Rows that repeat a doc_id stay or go
    together.
    """
    return simhash.dedup(docs, simhash.WIDE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: sampled so that source, language and topic come to their target shares.

    A null source or language is a value of its own, a null or empty text has one token.
    Rows that repeat a doc_id are sampled together, by a hash of it, so a rerun keeps the same.
    """
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the piece ids of each document: doc_id, ids, n_tokens and exact.

    A null text has null ids; an empty one the single marker piece.
    """
    return pieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: A trained model and a random projection have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Passing(spark) as passing:
            docs = passing.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
