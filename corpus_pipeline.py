"""Corpus pipeline: quality filter, near-duplicate removal, passage removal, mixing, packing.

Each stage takes all rows that its predecessor kept, and all but the last return the columns of
documents.  No SQL expresses a trained classifier or these joins, so ORACLE_SQL is None and the stages
are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from execlens.llm import mixing, neardup, packing, quality, substring
from execlens.llm.common import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among them, doesn't reject.

    Null, empty and blank texts have the bias's score and go where that is too low; repeated rows share their fate.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies.

    Null, empty and blank texts are no one's copy and stay; of rows of equal id and text one stays; rows without an id do.
    """
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that an earlier one holds taken out; n_chars follows the text.

    Null texts stay null, texts of fewer than 50 words and rows without an id as they are; no row goes.
    """
    cut = substring.remove_repeats(docs)
    n = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return (cut if n is None else cut.withColumn("n_chars", n)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none or several times.

    A null source is a source of its own; null and empty texts hold no words and come at their source's rate.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences; null and empty texts are their end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
