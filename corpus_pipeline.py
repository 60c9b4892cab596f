"""From raw documents to packed token sequences, in five stages.

Each stage takes what the stage before it kept. All but the last hand on rows of ``documents`` as they are; the last gives the
pieces and their places. Every stage handles null and empty texts, repeated rows, empty tables and further columns as its
operator's docstring says; further columns are handed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import exact_dedup, language_id, near_dedup, packing, toxicity
from riskloom.llm.common import divisible, table
from riskloom.llm.queries import WORD_BPE, vocabulary
from riskloom.session import shared_dir

#: Below this probability of the likeliest language a document is rejected.
LEAST_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: without a letter, or without a likely language. Learns from ``lang`` of its input."""
    net = language_id.train(language_id.labelled(docs, ~divisible("doc_id", 5), 400))
    if net is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return language_id.keep(docs, net, LEAST_LANGUAGE)


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are toxic. Learns from ``labels`` of the documents it gets."""
    return toxicity.keep(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), ~divisible("doc_id", 5)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words, a similarity of 0.8 or more."""
    return near_dedup.keep_first(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, vocabulary(WORD_BPE))


STAGES = [("language", language), ("toxicity", clean_language), ("exact", exact), ("near", near), ("packing", pack)]

#: Training and packing have no SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
