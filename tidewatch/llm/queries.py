"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, decontaminate, jaccard, lm, media, pieces, pii, quality, repair, reshard, secrets, url_filters
from ._spark import read


def piece_model() -> str:
    """Path of the public BPE model (a file of the host, never part of this repository)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": lambda spark, d: decontaminate.query(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op2_pii_deobfuscation": lambda spark, d: pii.query(read(spark, d, "documents")),
        "op3_media_sequences": lambda spark, d: media.query(read(spark, d, "documents")),
        "op4_quality_classifier": lambda spark, d: quality.query(read(spark, d, "documents"), read(spark, d, "labels")),
        "op5_maxent_language_model": lambda spark, d: lm.query(read(spark, d, "documents")),
        "op6_temporal_url_filters": lambda spark, d: url_filters.query(read(spark, d, "pages")),
        "op7_jaccard_join": lambda spark, d: jaccard.query(read(spark, d, "documents")),
        "op8_sentencepiece_rounds": lambda spark, d: pieces.query(read(spark, d, "documents"), piece_model()),
        "op9_secret_scan": lambda spark, d: secrets.query(read(spark, d, "documents")),
        "op10_chat_windows": lambda spark, d: chat.query(read(spark, d, "conversations")),
        "op11_min_cost_resharding": lambda spark, d: reshard.query(read(spark, d, "documents")),
        "op12_conversation_repair": lambda spark, d: repair.query(read(spark, d, "conversations")),
        "op13_vector_codes": lambda spark, d: codes.query(read(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_temporal_url_filters": url_filters.ORACLE, "op9_secret_scan": secrets.oracle(), "op11_min_cost_resharding": reshard.oracle(), "op12_conversation_repair": repair.oracle(), "op13_vector_codes": codes.oracle()}
