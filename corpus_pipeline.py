"""A corpus pipeline of five of the operators in plumbline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
back as the next stage's documents. Decisions take effect: rejected, duplicate and contaminated
documents go, recurring lines are cut out of texts. All stages but the last return the columns of documents.

Defined results for odd input: a null text, one without a letter, or one that no mixture of the learned languages explains goes in the first stage. Null ids and null cells in other columns go
through; rows that repeat both id and text stay or go together. A document all of whose lines recur in earlier documents goes in the second stage.
Extra columns go through up to the last stage, whatever their names. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece
from plumbline.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no mixture of learned languages explains go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates are cut out of all documents but the first that has them; those of which nothing is left go."""
    return line_dedup.dedup(docs, keep_first=True).select(*docs.columns).where(F.col("text").rlike(r"[^ \t-\r]"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return jaccard_join.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids, checked by decoding them."""
    return sentencepiece.round_trip(docs, sentencepiece.load(spark))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_recurring_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_passages),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Mixture inference and MinHash candidates are not expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
