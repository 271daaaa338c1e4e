"""Readers of answers and tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import pdf_markdown
from ..errors import ExtractionError
from ..functions import text as T
from ..operators import references
from . import docx
from . import pdf as pdf_file

MARKDOWN = (".md", ".markdown")
Convert = Callable[[bytes], str]


def _files(spark: SparkSession, paths: str | list[str], stamp: datetime | None) -> DataFrame:
    """(path, content, suffix, content_hash, answer_id); the id ends with the time of the run, where one is given."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "")
    files = files.withColumns({"suffix": T.suffix(F.col("path")), "content_hash": F.sha2("content", 256)})
    short = F.concat_ws("_", stem, F.substring("content_hash", 1, 12))
    return files.withColumn("answer_id", T.run_id(stem, F.col("content"), F.lit(stamp)) if stamp else short)


def read_answers(spark: SparkSession, paths: str | list[str], tool_name: str, pdf: Convert = pdf_markdown, stamp: datetime | None = None) -> DataFrame:
    """Answers of files by their suffix: Markdown as text, DOCX by its XML, PDF by a converter.

    Rows (answer_id, tool_name, suffix, text, content_hash, path); an unknown suffix is an ``ExtractionError``. With a
    ``stamp`` (the time of a run) the same file gives a new id, hence a new run, each time.
    """
    files = _files(spark, paths, stamp)
    odd = files.where(~F.col("suffix").isin(*MARKDOWN, ".pdf", ".docx")).select("path").first()
    if odd:
        raise ExtractionError(f"unknown kind of file: {odd['path']}", path=odd["path"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["text"] = [docx.to_markdown(c) if s == ".docx" else pdf(c) for s, c in zip(part["suffix"], part["content"])]
            yield part.drop(columns="content")

    plain = files.where(F.col("suffix").isin(*MARKDOWN)).select("path", "suffix", "content_hash", "answer_id", F.decode("content", "UTF-8").alias("text"))
    other = files.where(~F.col("suffix").isin(*MARKDOWN)).mapInPandas(run, "path string, suffix string, content_hash string, answer_id string, text string")
    return plain.union(other).select("answer_id", F.lit(tool_name).alias("tool_name"), "suffix", "text", "content_hash", "path")


def read_pdf_links(spark: SparkSession, paths: str | list[str], stamp: datetime | None = None) -> DataFrame:
    """(answer_id, url): distinct web links of the PDF files among the paths."""
    files = _files(spark, paths, stamp).where("suffix = '.pdf'")
    return references.pdf_links(links_of(files, "answer_id").withColumnRenamed("key", "answer_id"))


def links_of(files: DataFrame, key: str) -> DataFrame:
    """(key, uri) of the link annotations in (key, content)."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(k, u) for k, c in zip(part["key"], part["content"]) for u in pdf_file.uris(c)]
            yield pd.DataFrame(rows, columns=["key", "uri"])

    return files.select(F.col(key).alias("key"), "content").mapInPandas(run, f"key {kind}, uri string")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of JSON lines with a declared schema; blank lines are no rows, a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)
