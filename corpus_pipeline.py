"""The corpus pipeline: ``STAGES`` over ``documents``, each stage reading what the one before it wrote.

language    documents in no known language go
near copies one document of each group of near copies stays
passages    passages of 50 words or more that stand in an earlier document are cut out
mixing      every document, repeated as often as it takes for all sources to have the tokens of the longest
encoding    sampled SentencePiece segmentations of every document that is left
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundcheck.llm import langid, mixing, rlz, segment, simhash
from groundcheck.llm.common import settled
from groundcheck.llm.queries import SENTENCEPIECE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rlz.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segment.encoded(docs, SENTENCEPIECE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", cut_repeats),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
