"""The corpus pipeline: five stages over documents, each with one operator of ``hrefsieve.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from hrefsieve.llm.queries import TOKENIZER
from hrefsieve.llm.tables import cut, table

#: shares of all tokens that the mix aims at
WEIGHTS = {"good": 0.95, "low": 0.05}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared with an earlier document go; ``n_chars`` follows the text."""
    left = line_dedup.without_common_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates on two-word shingles stays.

    A word that was changed takes two such shingles with it, of five words it would be five:
    near copies that differ in one word of fifty are no near-duplicates any more.
    """
    return near_dedup.one_of_each(docs, width=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of good and poor text want them."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"), mixing.by_quality(), WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the learnt scores and rates
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
