"""A training-data pipeline: five of the operators, one after another.

Each stage takes what its predecessor kept, and its decisions take effect: rows
go or texts change (n_chars with them); all but the last return the columns of
documents.  Between stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm import copies, lines, packing, quality, substrings
from phasegrid.llm.common import Scratch, documents
from phasegrid.llm.registry import vocabulary


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts."""
    return quality.accept(docs, documents(spark, sf_dir, "labels"), Scratch(spark))


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines similar to an earlier one."""
    return lines.clean(docs, Scratch(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, Jaccard similarity 0.8 or more."""
    return copies.keep_one(docs, Scratch(spark))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 35 words or more that stand earlier."""
    return substrings.clean(docs, Scratch(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its place in a sequence of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary(), Scratch(spark))


STAGES = [
    ("accept_quality", accept_quality),
    ("drop_similar_lines", drop_similar_lines),
    ("drop_near_copies", drop_near_copies),
    ("drop_repeated_passages", drop_repeated_passages),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the classifier, the signatures or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = documents(spark, sf_dir), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
