"""Queries of this package for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op4_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import nbest_digests

    return nbest_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(table(spark, sf_dir, "conversations"))


def op9_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 2)


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from .chat import ORACLE

    return {"op8_chat_perspectives": ORACLE}
