"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentivote.llm import cross_parse, importance, near_join, packing, personal  # noqa: E402
from sentivote.llm.common import written  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling draws; texts without tokens go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.kept_documents(docs, labels)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text has a language."""
    return cross_parse.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id."""
    return near_join.kept_documents(docs)


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return personal.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents, as sequences of bytes, into bins."""
    return packing.packed(docs, "doc_id", F.octet_length(F.col("text")))


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("privacy", privacy), ("pack", pack)]

#: No SQL expresses learnt models, hashed forests or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
