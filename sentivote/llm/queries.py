"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentivote.llm import (
    cross_parse, fill_middle, importance, main_text, mixing, near_join, packing, personal, piece_codec, pivots, prefix_forest,
    secret_scan, substring_crc,
)

#: Model file of the tokenizer that ``op9`` uses.
PIECES = os.environ.get("SENTIVOTE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(vectors, F.col("vec_id") % 20 == 0)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extracted(table(spark, sf_dir, "pages"))


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_parse.identified(table(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encoded(table(spark, sf_dir, "documents"), piece_codec.Vocabulary.load(PIECES))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences of bytes."""
    documents = table(spark, sf_dir, "documents")
    return packing.packed(documents, "doc_id", F.octet_length(F.col("text")))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_substring_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_crc.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_prefix_forest, op2_main_text, op3_importance, op4_pivots, op5_personal, op6_secrets, op7_near_join,
            op8_cross_parse, op9_pieces, op10_packing, op11_fill_middle, op12_mixing, op13_substring_crc,
        )
    }
