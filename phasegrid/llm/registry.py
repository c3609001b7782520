"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phasegrid.llm import backoff, bpe, embeddings, lines, media, packing, quality, simhash, substrings, suffixes
from phasegrid.llm.common import Scratch, documents


def vocabulary() -> str:
    """Path of the byte-level vocabulary; PHASEGRID_BPE names another."""
    if own := os.environ.get("PHASEGRID_BPE"):
        return own
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(), Scratch(spark))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), Scratch(spark))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(documents(spark, sf_dir), Scratch(spark))


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(documents(spark, sf_dir), Scratch(spark))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary())


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(documents(spark, sf_dir))


def op6_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(documents(spark, sf_dir, "embeddings"), Scratch(spark))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(documents(spark, sf_dir), Scratch(spark))


def op9_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.score(documents(spark, sf_dir), Scratch(spark))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), Scratch(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_discriminant": op2_quality_discriminant,
    "op3_suffix_arrays": op3_suffix_arrays,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_sign_hashing": op6_sign_hashing,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_matroska": op8_matroska,
    "op9_stupid_backoff": op9_stupid_backoff,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op9_stupid_backoff": backoff.ORACLE}
