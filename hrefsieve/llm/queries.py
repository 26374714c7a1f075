"""The registered queries of this package: each applies one operator to a whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hrefsieve.llm import bpe, conversations, jaccard_join, licences, line_dedup, mixing, near_dedup, neighbours, oracle, outliers, sharding, tool_calls, toxicity, whitening
from hrefsieve.llm.tables import table

def _tokenizer() -> str:
    """The tokenizer file of the encoding query: ``TOKENIZER_FILE``, else the installed one of this name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TOKENIZER = os.environ.get("TOKENIZER_FILE") or _tokenizer()

Query = Callable[[SparkSession, str], DataFrame]


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and robust outliers of all documents, by language and source."""
    return outliers.score(table(spark, sf_dir, "documents"))


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_patience_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence texts in all documents."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_bpe_speculate_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by its nearest labelled examples."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_line_alignment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines they share with earlier ones."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls and results that all conversations stand for, linked and serialised."""
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


#: shares of all tokens that the mix aims at
MIX = {"good": 0.92, "low": 0.05, "toxic": 0.03}


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares of good, low and toxic text."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, labels, mixing.by_quality_and_toxicity(), MIX).drop("version")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by three-word shingles of a similarity of 0.9."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of all vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("residual")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mcd_outliers, op2_learned_partitions, op3_patience_licences, op4_bpe_speculate_verify, op5_toxicity_neighbours, op6_byte_shards, op7_line_alignment_dedup, op8_tool_calls, op9_soft_mixing, op10_minhash_near_dedup, op11_jaccard_join, op12_chebyshev_whitening, op13_conversation_repair)}

ORACLES: dict[str, str] = {"op8_tool_calls": oracle.TOOL_CALLS, "op10_minhash_near_dedup": oracle.NEAR_DUPLICATES, "op11_jaccard_join": oracle.JACCARD_JOIN}
