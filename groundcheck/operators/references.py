"""Source lists of answers: text to rows, all answers at once.

Entries are (answer_id, source_rank, ord, markers, title, url); references add id and normalised URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..schemas import EXTRACTED_JSON

REPAIR_BUDGET = 5
_LEADING_MARKERS = r"^((?:\[\s*\d+\s*\]\s*)+)"
_TOKEN = r"(?is)(?<!\S)(?:[-*#][\t ]*)*\d+[.][\t ]*|<u>.*?</u>"


def _lines(answers: DataFrame, of: Column) -> DataFrame:
    rows = answers.select("answer_id", F.posexplode_outer(F.split(of, T.LINE_END)).alias("pos", "line")).where("pos IS NOT NULL")
    return rows.withColumn("line", T.strip(F.col("line")))


def bracket_entries(answers: DataFrame) -> DataFrame:
    """``[n]`` at the start of a line, with the first URL there or further down before the next such line."""
    rows = _lines(answers, F.col("text")).withColumn("run", F.regexp_extract("line", _LEADING_MARKERS, 1))
    rows = rows.withColumn("rest", F.when(F.col("run") != "", T.strip(F.substr("line", F.length("run") + 1))).otherwise(F.col("line")))
    before, url = T.url_parts(F.col("rest"))
    order = W.partitionBy("answer_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"before": before, "url": url, "entry": F.sum((F.col("run") != "").cast("int")).over(order)}).where("entry > 0")
    groups = rows.groupBy("answer_id", "entry").agg(
        F.array_sort(F.collect_list(F.struct("pos", "run", "rest", "before", "url"))).alias("g")
    )
    title = F.array_join(F.transform(F.filter("g", lambda x: (x["pos"] < F.col("hit.pos")) & (x["rest"] != "")), lambda x: x["rest"]), " ")
    return (
        groups.withColumn("hit", F.try_element_at(F.filter("g", lambda x: x["url"] != ""), F.lit(1))).where("hit IS NOT NULL")
        .select(
            "answer_id", F.lit(1).alias("source_rank"), F.col("entry").cast("int").alias("ord"),
            F.transform(F.regexp_extract_all(F.col("g")[0]["run"], F.lit(r"(\d+)"), F.lit(1)), lambda n: F.concat(F.lit("["), n, F.lit("]"))).alias("markers"),
            F.when(F.col("hit.run") != "", T.strip(F.col("hit.before"))).otherwise(title).alias("title"), F.col("hit.url").alias("url"),
        )
    )


def numbered_entries(answers: DataFrame) -> DataFrame:
    """``n.`` after the list's anchor; the underlined parts up to the next number make the URL."""
    listed = F.regexp_extract_all(T.source_tail(F.col("text")), F.lit(_TOKEN), F.lit(0))
    tokens = answers.select("answer_id", F.posexplode_outer(listed).alias("pos", "token")).where("pos IS NOT NULL")
    part = F.regexp_extract("token", r"(?is)^<u>(.*)</u>\z", 1)
    tokens = tokens.withColumns({"number": F.regexp_extract("token", r"(?s)^[-*#\t ]*(\d+)[.][\t ]*\z", 1), "part": part})
    order = W.partitionBy("answer_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    tokens = tokens.withColumn("entry", F.sum((F.col("number") != "").cast("int")).over(order)).where("entry > 0")
    groups = tokens.groupBy("answer_id", "entry").agg(
        F.max(F.nullif("number", F.lit(""))).alias("number"), F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts")
    )
    joined = F.array_join(F.transform("parts", lambda x: F.replace(F.regexp_replace(x["part"], r"[\n\r]", ""), F.lit("\t"), F.lit(" "))), "")
    return (
        groups.withColumn("url", F.replace(T.strip(joined), F.lit(" "), F.lit("%20"))).where("url <> ''")
        .select("answer_id", F.lit(2).alias("source_rank"), F.col("entry").cast("int").alias("ord"),
                F.array(F.concat(F.lit("["), "number", F.lit("]"))).alias("markers"), F.lit("").alias("title"), "url")
    )


def _url_lines(answers: DataFrame, tail: Column) -> DataFrame:
    """Lines of a tail that hold a URL, numbered from 1, split where it starts."""
    rows = _lines(answers.where(tail.isNotNull()), tail)
    split = r"(?s)^(.*?)(" + T.URL + r".*)\z"
    rows = rows.withColumns({"title": F.regexp_extract("line", split, 1), "url": F.regexp_extract("line", split, 2)}).where("url <> ''")
    return rows.withColumn("ord", F.row_number().over(W.partitionBy("answer_id").orderBy("pos")))


def _ordinal(rows: DataFrame, rank: int, title: Column, url: Column) -> DataFrame:
    mark = F.array(F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("]")))
    return rows.select("answer_id", F.lit(rank).alias("source_rank"), "ord", mark.alias("markers"), title.alias("title"), url.alias("url"))


def bare_url_entries(answers: DataFrame) -> DataFrame:
    """One URL a line after the asterism; spaces in it are escaped."""
    return _ordinal(_url_lines(answers, T.asterism_tail(F.col("text"))), 2, F.lit(""), F.replace("url", F.lit(" "), F.lit("%20")))


def titled_pairs(answers: DataFrame) -> DataFrame:
    """``Title, URL`` lines after the heading; spaces in the URL stay."""
    return _ordinal(_url_lines(answers, T.heading_tail(F.col("text"))), 3, T.strip(F.regexp_replace("title", r"[ ,]+\z", "")), F.col("url"))


def _unless(first: DataFrame, second: DataFrame) -> DataFrame:
    """``first``, and ``second`` for the answers that ``first`` has nothing for."""
    return first.unionByName(second.join(first.select("answer_id").distinct(), "answer_id", "left_anti"))


def entries(answers: DataFrame) -> DataFrame:
    """Bracketed entries and then the asterism's; titled pairs only for answers with neither."""
    listed = _unless(numbered_entries(answers), bare_url_entries(answers))
    return _unless(bracket_entries(answers).unionByName(listed), titled_pairs(answers))


def merge(found: DataFrame) -> DataFrame:
    """References: the first entry of each page gives URL and title, later ones add the markers it lacks."""
    keyed = found.withColumn("normalized_url", T.normalize_url(F.col("url")))
    keyed = keyed.withColumn("id", T.url_id(F.col("normalized_url")))
    groups = keyed.groupBy("answer_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("source_rank", "ord", "markers", "title", "url", "normalized_url"))).alias("g")
    )
    head, more = F.col("g")[0], F.flatten(F.transform(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), lambda x: x["markers"]))
    return groups.select(
        "answer_id", "id", F.row_number().over(W.partitionBy("answer_id").orderBy(head["source_rank"], head["ord"])).alias("ord"),
        F.concat(head["markers"], F.array_except(more, head["markers"])).alias("citation_markers"),
        head["url"].alias("raw_url"), head["normalized_url"].alias("normalized_url"), head["title"].alias("title"),
    )


def mended(refs: DataFrame, links: DataFrame) -> DataFrame:
    """References with ``url``: the raw URL, or the link embedded in the same answer's file that it is a damaged form of.

    The known URL with the same fuzzy key wins, else the one that needs fewest of at most ``REPAIR_BUDGET`` characters
    put back; ties by URL. Answers without known links are left as they are.
    """
    known = links.select("answer_id", F.col("url").alias("known")).distinct()
    ours = refs.withColumn("key", T.fuzzy_url_key(F.col("raw_url")))
    asked = ours.where("key IS NOT NULL").select("answer_id", "key").distinct()
    near = _one_apart(asked, known)
    best = near.union(_further_apart(asked.join(near, ["answer_id", "key"], "left_anti"), known))
    best = ours.join(best, ["answer_id", "key"]).groupBy("answer_id", "id").agg(F.min("best").alias("best"))
    return refs.join(best, ["answer_id", "id"], "left").withColumn("url", F.coalesce("best.known", "raw_url")).drop("best")


def _closest(pairs: DataFrame) -> DataFrame:
    """(answer_id, key, best) of pairs with a ``known_key`` in which ``key`` stands."""
    gap = F.length("known_key") - F.length("key")
    pairs = pairs.where(gap.between(0, REPAIR_BUDGET)).where(T.is_subsequence(F.col("key"), F.col("known_key")))
    return pairs.groupBy("answer_id", "key").agg(F.min(F.struct(gap.alias("gap"), F.col("known").alias("known"))).alias("best"))


def _one_apart(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The closest known URL of a key at most one character longer: a join on known keys with each of their characters out."""
    key = T.fuzzy_url_key(F.col("known"))
    out = F.transform(F.sequence(F.lit(0), F.length("known_key")), lambda i: F.xxhash64(F.concat(F.substr("known_key", F.lit(1), i - 1), F.substr("known_key", i + 1))))  # 0: none
    rows = known.select("answer_id", "known", key.alias("known_key")).where("known_key IS NOT NULL")
    rows = rows.select("answer_id", "known", F.explode_outer(F.array_distinct(out)).alias("hash")).where("hash IS NOT NULL")
    return _closest(asked.withColumn("hash", F.xxhash64("key")).join(rows, ["answer_id", "hash"]).withColumn("known_key", key))


def _further_apart(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The closest known URL of a key among those that are 2 to ``REPAIR_BUDGET`` characters longer.

    Keys meet the known ones of a length; pairs in which the known one lacks a character of the key, by a mask of 126 bits of
    the characters and their number, go before any are compared.
    """

    def masked(rows: DataFrame, key: str) -> DataFrame:
        rows = rows.withColumn("_c", F.array_sort(F.split(key, "")))
        rows = rows.withColumn("_b", F.expr("transform(_c, (c, i) -> cast(pmod(xxhash64(c, i - array_position(_c, c)), 126) AS int))"))
        bits = lambda at: F.expr(f"aggregate(_b, 0L, (m, b) -> m | if(b >= {at} AND b < {at + 63}, shiftleft(1L, b - {at}), 0L))")
        half = lambda at: F.coalesce(bits(at), F.lit(0).cast("bigint"))  # noqa: E731  # never null, or the join would check for that by a filter that makes it anew
        return rows.withColumns({f"{key}_0": half(0), f"{key}_1": half(63)}).drop("_c", "_b")

    rows = masked(known.withColumn("known_key", T.fuzzy_url_key(F.col("known"))).where("known_key IS NOT NULL"), "known_key").withColumn("length", F.length("known_key"))
    keys = masked(asked, "key").withColumn("gap", F.explode(F.array(*[F.lit(g) for g in range(2, REPAIR_BUDGET + 1)]))).withColumn("length", F.length("key") + F.col("gap")).drop("gap")
    has = lambda n: F.expr(f"key_{n} & ~known_key_{n}") == 0
    return _closest(keys.join(rows, ["answer_id", "length"]).where(has(0) & has(1)))


def repaired(refs: DataFrame, links: DataFrame) -> DataFrame:
    """References with mended URLs, merged anew."""
    return merge(mended(refs, links).select("answer_id", F.lit(1).alias("source_rank"), "ord", F.col("citation_markers").alias("markers"), "title", "url"))


EXTRACT = (
    "List the sources that the text you are given cites: one entry a source, with the marks that cite it, such as [1], its URL "
    "and its title. Take URLs letter by letter from the text; leave out sources without one. Answer with one JSON object."
)
_TEXT = {"type": "string"}
_ENTRY = {"citation_markers": {"type": "array", "items": _TEXT}, "url": _TEXT, "title": _TEXT}
EXTRACTED_SHAPE = {
    "type": "object", "additionalProperties": False, "required": ["references"],
    "properties": {"references": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": list(_ENTRY), "properties": _ENTRY}}},
}


class ReferenceModel(Protocol):
    """A model that lists the sources of an answer: text to the JSON object of ``EXTRACTED_JSON``."""

    def __call__(self, text: str) -> str: ...


def model_entries(answers: DataFrame, model: ReferenceModel) -> DataFrame:
    """Entries by a model, one call an answer; a reply that is not the declared object gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"answer_id": pdf["answer_id"], "reply": [model(t) for t in pdf["text"]]})

    replies = answers.select("answer_id", "text").mapInPandas(run, "answer_id string, reply string")
    listed = replies.select("answer_id", F.posexplode(T.json_object(F.col("reply"), EXTRACTED_JSON)["references"]).alias("pos", "r"))
    return listed.select(
        "answer_id", F.lit(1).alias("source_rank"), (F.col("pos") + 1).alias("ord"), F.coalesce("r.citation_markers", F.array().cast("array<string>")).alias("markers"),
        F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.url").alias("url"),
    ).where("url IS NOT NULL")


def extract(answers: DataFrame, links: DataFrame | None = None, model: ReferenceModel | None = None) -> DataFrame:
    """References of all answers (pending); answers from ``.pdf`` files are repaired from ``links``."""
    refs = merge(model_entries(answers, model) if model else entries(answers))
    if links is not None:
        paged = answers.where(F.lower("suffix") == ".pdf").select("answer_id")
        refs = repaired(refs, links.join(paged, "answer_id", "left_semi"))
    tools = answers.select("answer_id", "tool_name")
    return refs.join(tools, "answer_id").select(
        "answer_id", "id", "ord", "citation_markers", "raw_url", "normalized_url", "title", F.lit("pending").alias("status"),
        F.lit(None).cast("int").alias("http_status"), F.lit(None).cast("timestamp").alias("fetched_at"),
        F.lit(None).cast("string").alias("error_message"), "tool_name",
    )


def pdf_links(annotations: DataFrame) -> DataFrame:
    """Distinct web links of files, fragments cut, from (answer_id, uri)."""
    url = F.substring_index("uri", "#", 1)
    return annotations.where(F.col("uri").rlike("^https?://")).select("answer_id", url.alias("url")).distinct()
