"""Claims of answers: the text before each run of citation marks, with the references the marks resolve to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def segments(answers: DataFrame, *keep: str) -> DataFrame:
    """(answer_id, position, text, markers, further columns): one row a claim, positions dense from 0; no shuffle.

    The outer form of explode is used with a filter after it: from the inner one the optimiser infers filters that
    would work out the segments again.
    """
    norm = T.canonical_markers(T.strip_source_section(F.col("text")))
    runs = F.regexp_extract_all("norm", F.lit(f"({T.MARKER_RUN})"), F.lit(1))  # not inside a lambda, which would repeat it
    digits = lambda run: F.transform(
        F.regexp_extract_all(F.coalesce(run, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("["), n, F.lit("]"))
    )
    zipped = F.filter(
        F.zip_with(F.split("norm", T.MARKER_RUN, -1), runs, lambda s, r: F.struct(T.strip(s).alias("text"), digits(r).alias("markers"))),
        lambda x: x["text"] != "",
    )
    rows = answers.select("answer_id", *keep, norm.alias("norm"))
    rows = rows.select("answer_id", *keep, F.posexplode_outer(zipped).alias("position", "c")).where("position IS NOT NULL")
    return rows.select("answer_id", "position", "c.text", "c.markers", *keep)


def marker_index(refs: DataFrame) -> DataFrame:
    """(answer_id, marker, reference_id): of references that share a marker the last one has it."""
    return (
        refs.select("answer_id", "id", "ord", F.explode("citation_markers").alias("marker"))
        .groupBy("answer_id", "marker").agg(F.max_by("id", "ord").alias("reference_id"))
    )


def claims(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """Claims with the distinct references of their marks, in order; unknown marks are dropped.

    An answer's marks are few, so they are joined to the answer as one map before its text is taken apart: the join
    moves answers, not claims, and no mark is exploded.
    """
    index = marker_index(refs).groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("marker", "reference_id"))).alias("_index"))
    rows = segments(answers.join(index, "answer_id", "left"), "_index")
    found = F.array_distinct(F.array_compact(F.transform("markers", lambda m: F.try_element_at("_index", m))))
    return rows.select(
        F.concat_ws("-", "answer_id", F.col("position").cast("string")).alias("id"), "answer_id", "position", "text",
        F.coalesce(found, F.array().cast("array<string>")).alias("cited_reference_ids"),
    )
