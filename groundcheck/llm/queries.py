"""Queries over the synthetic tables, one for each operator, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, langid, licenses, mixing, readability, rlz, segment, simhash, vectors, warc
from .common import table

#: The vocabulary file that the queries use; a parameter of the operator.
SENTENCEPIECE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.rebuilt(table(spark, sf_dir, "pages"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.from_texts(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.factors(table(spark, sf_dir, "documents"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.extracted(table(spark, sf_dir, "pages"))


def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str, model_path: str = SENTENCEPIECE) -> DataFrame:
    return segment.encoded(table(spark, sf_dir, "documents"), model_path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_mpeg_audio, op3_simhash_near_dedup, op4_substring_dedup, op5_embedding_near_dedup, op6_license_scan,
        op7_source_mixing, op8_language_id, op9_html_extraction, op10_sentencepiece_sampling,
    )
}

#: What SQL cannot express is tested against brute force instead.
ORACLE: dict[str, str] = {"op1_warc": warc.SQL}
