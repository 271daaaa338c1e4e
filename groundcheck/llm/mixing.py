"""Mixing of sources to target weights by balanced sampling with the cube method.

Every document of a source gets the same inclusion probability, such that the sources' expected tokens stand in the
target proportions. The flight phase (Deville and Tillé, 2004; fast form of Chauvet and Tillé, 2006) moves the
probabilities of three documents at a time along the null space of the two constraints, the number of documents and the
number of tokens of their source, until each is 0 or 1. It runs in buckets, then over what the buckets of a source left;
two fractional documents a source at most are then landed with the number of documents kept, tokens given up.

Defined cases: a document's tokens are its words by white space, 0 for null and empty texts; a null source is a source
of its own; rows that share a doc_id are one unit of their source, sampled together, and so are rows without one that
share their text; a ``share`` or ``total`` outside 0 to 1 is a ValueError; a source without tokens, or with a target of 0 or below, is left out; sources that ``targets`` does not name
have a target of 0, and without ``targets`` all sources have equal targets; ties in tokens fall back to exchanging
probability between two documents; an empty table gives an empty sample; further columns are kept by ``mixed``.

Exact proportions cut every source to what the shortest one allows. With ``total`` the sample has that part of all tokens
of the targeted sources instead, whatever the shortest holds: sources too short for their target are taken whole, and the
others fill the total in their target proportions.

``weighted`` and ``repeated`` leave no document of a targeted source out: documents are repeated until every source has as
many tokens as its target asks for next to the source that is longest for its own, whose documents count once. The number
of copies that a source's documents should have is seldom whole; the cube method draws which of them have one more. A
targeted source without tokens reaches no target and its documents count once. The result so has the tokens of the longest
source for each source of equal target: a very short source next to a very long one is repeated very often.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import carried, cut, fresh

BUCKET_ROWS = 20_000
TOTAL = 1.0  # what the registered query and the pipeline keep of all tokens: they reach the targets by repeating
CHUNK = 1000  # copies of a row that are counted out at one time
EPS = 1e-9


def flight(prob: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: at most two are neither 0 nor 1; their sum and the sum of prob * tokens are kept."""
    prob = prob.astype(float).copy()
    size = tokens.astype(float)
    draws = iter(rng.random(len(prob) + 8).tolist())
    p, t = prob.tolist(), size.tolist()
    live: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
            if not (u[0] or u[1] or u[2]):
                u = (1.0, -1.0, 0.0)
            up = down = float("inf")
            for k, step in zip(live, u):
                if step > 0:
                    up, down = min(up, (1 - p[k]) / step), min(down, p[k] / step)
                elif step < 0:
                    up, down = min(up, -p[k] / step), min(down, (p[k] - 1) / step)
            move = up if next(draws) * (up + down) < down else -down
            for k, step in zip(live, u):
                p[k] = min(1.0, max(0.0, p[k] + move * step))
                p[k] = 0.0 if p[k] < EPS else 1.0 if p[k] > 1 - EPS else p[k]
            live = [k for k in live if 0 < p[k] < 1]
    return np.array(p)


def landing(prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for what is still fractional, keeping each expectation and, but for a last one, the number of documents."""
    prob = prob.copy()
    live = [int(i) for i in np.flatnonzero((prob > EPS) & (prob < 1 - EPS))]
    while len(live) > 1:
        a, b = live[-2:]
        up, down = min(1 - prob[a], prob[b]), min(prob[a], 1 - prob[b])
        move = up if rng.random() * (up + down) < down else -down
        prob[a], prob[b] = prob[a] + move, prob[b] - move
        live = [k for k in live if EPS < prob[k] < 1 - EPS]
    for k in live:
        prob[k] = float(rng.random() < prob[k])
    return np.round(prob)


def _rng(seed: int, *parts: object) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh3_64_intdigest(repr((seed, *parts))))


def _text_key(docs: DataFrame) -> Column:
    return F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0).cast("bigint"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, h, tokens): documents, their rows together; h tells rows without an id apart."""
    words = F.size(F.filter(F.split(F.coalesce(docs["text"], F.lit("")), r"\s+"), lambda w: w != ""))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), _text_key(docs).alias("h"), words.cast("bigint").alias("tokens"))
    return rows.groupBy("doc_id", "source", "h").agg(F.sum("tokens").alias("tokens"))


def _totals(held: DataFrame, targets: Mapping[str | None, float] | None) -> DataFrame:
    """(source, all_tokens, n, w) of each targeted source."""
    totals = held.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("n"))
    if targets is None:
        return totals.withColumn("w", F.lit(1.0))
    given = held.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items() if v > 0], "_s string, w double")
    return totals.join(given, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def plan(held: DataFrame, targets: Mapping[str | None, float] | None, share: float, total: float | None = None) -> DataFrame:
    """(source, prob, buckets) for each source: the largest mix in the target proportions or one of ``total``, times ``share``."""
    totals = _totals(held, targets).where("all_tokens > 0")
    if total is None:
        level = totals.agg(F.min(F.col("all_tokens") / F.col("w")).alias("_level"))
    else:  # the level at which sum(min(all_tokens, level * w)) is the total; one row a source is sorted
        order = W.orderBy(F.col("all_tokens") / F.col("w"), "source")
        shorter = F.coalesce(F.sum("all_tokens").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        others = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
        wanted = F.sum("all_tokens").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * total
        level = totals.select(((wanted - shorter) / others).alias("_one")).agg(F.max("_one").alias("_level"))
    return totals.crossJoin(level).select(
        "source", (F.least(F.lit(1.0), F.col("_level") * F.col("w") / F.col("all_tokens")) * share).alias("prob"),
        F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"),
    )


def repeats(held: DataFrame, targets: Mapping[str | None, float] | None) -> DataFrame:
    """(source, expected, least, prob, buckets) for each targeted source: the copies that its documents have on average, the
    whole ones among them, and the chance of one more."""
    totals = _totals(held, targets)
    level = totals.agg(F.max(F.col("all_tokens") / F.col("w")).alias("_level"))
    expected = F.when(F.col("all_tokens") > 0, F.greatest(F.lit(1.0), F.col("_level") * F.col("w") / F.col("all_tokens"))).otherwise(1.0)
    rows = totals.crossJoin(level).select("source", expected.alias("expected"), F.ceil(F.col("n") / BUCKET_ROWS).alias("buckets"))
    rows = rows.withColumn("least", F.floor(F.col("expected") + EPS).cast("bigint"))
    prob = F.col("expected") - F.col("least")
    return rows.select("source", "expected", "least", F.when(prob > EPS, prob).otherwise(0.0).alias("prob"), "buckets")


def sampled(docs: DataFrame, targets: Mapping[str | None, float] | None = None, share: float = 1.0, seed: int = 7, total: float | None = None) -> DataFrame:
    """The balanced sample: (doc_id, source, tokens, prob) of the documents that stay."""
    return _sampled(docs, targets, share, seed, total).select("doc_id", "source", "tokens", "prob")


def _sampled(docs: DataFrame, targets: Mapping[str | None, float] | None, share: float, seed: int, total: float | None) -> DataFrame:
    if not 0 <= share <= 1 or total is not None and not 0 <= total <= 1:
        raise ValueError("share and total are parts, from 0 to 1")
    held = cut(units(docs))
    return _drawn(held, plan(held, targets, share, total), seed)


def _drawn(held: DataFrame, chances: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, h, tokens, prob) of the units that the cube method draws by the chances of their sources."""
    chances = chances.select(F.col("source").alias("_s"), "prob", "buckets")
    rows = held.join(chances, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "h"), F.col("buckets"))
    )

    def fly(pdf: pd.DataFrame, *what: object) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h"], na_position="first")
        return pdf.assign(now=flight(pdf["now"].to_numpy(), pdf["tokens"].to_numpy(), _rng(seed, *what)))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fly(pdf[["doc_id", "source", "h", "tokens", "prob"]].assign(now=pdf["prob"]), "bucket", key[0], int(key[1]))

    def rest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = fly(pdf, "source", key[0])
        return pdf.assign(now=landing(pdf["now"].to_numpy(), _rng(seed, "land", key[0])))

    schema = "doc_id bigint, source string, h bigint, tokens bigint, prob double, now double"
    flown = cut(rows.select("doc_id", "source", "h", "tokens", "prob", "bucket").groupBy("source", "bucket").applyInPandas(first, schema).where("now > 0"))
    left = flown.where("now < 1").groupBy("source").applyInPandas(rest, schema)
    return flown.where("now = 1").union(left.where("now = 1")).select("doc_id", "source", "h", "tokens", "prob")


def _copies(docs: DataFrame, targets: Mapping[str | None, float] | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, ``repeats`` by source, and the (doc_id, source, h) of the units that have one copy more than their source's least."""
    held = cut(units(docs))
    by = cut(repeats(held, targets))
    return held, by, cut(_drawn(held, by.where("prob > 0"), seed).select("doc_id", "source", "h"))


def _counted(rows: DataFrame, by: DataFrame, more: DataFrame, key: list[Column]) -> DataFrame:
    """``rows``, which have the unit ``key``, of the targeted sources, with ``_expected`` and ``_n``, the copies."""
    by = by.select(F.col("source").alias("_by"), F.col("expected").alias("_expected"), F.col("least").alias("_least"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("source").alias("_of"), F.col("h").alias("_text"), F.lit(1).alias("_more"))
    rows = rows.join(F.broadcast(by), key[1].eqNullSafe(F.col("_by")))
    same = key[0].eqNullSafe(F.col("_id")) & key[1].eqNullSafe(F.col("_of")) & (key[2] == F.col("_text"))
    return rows.join(carried(more), same, "left").withColumn("_n", F.col("_least") + F.coalesce("_more", F.lit(0))).drop("_by", "_least", "_id", "_of", "_text", "_more")


def weighted(docs: DataFrame, targets: Mapping[str | None, float] | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, expected, copies) of every document of a targeted source; its copies in the mix, and how many
    the documents of its source have on average."""
    held, by, more = _copies(docs, targets, seed)
    out = _counted(held, by, more, [held["doc_id"], held["source"], held["h"]])
    return out.select("doc_id", "source", "tokens", F.col("_expected").alias("expected"), F.col("_n").alias("copies"))


def repeated(docs: DataFrame, targets: Mapping[str | None, float] | None = None, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as ``weighted`` says, one after the other."""
    _, by, more = _copies(docs, targets, seed)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("bigint").alias("_d"), docs["source"].cast("string").alias("_s"), _text_key(docs).alias("_h"))
    rows = _counted(rows, by, more, [rows["_d"], rows["_s"], rows["_h"]]).select("_row", F.col("_n").cast("bigint").alias("_n"))
    rows = rows.select("_row", "_n", F.explode(F.sequence(F.lit(0), ((F.col("_n") - 1) / CHUNK).cast("int"))).alias("_c"))
    rows = rows.select("_row", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.col("_n") - F.col("_c") * CHUNK).cast("int"))))
    return rows.select("_row.*")


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of ``docs`` whose document is in the sample."""
    d, s, h = fresh(docs, "_d"), fresh(docs, "_s"), fresh(docs, "_h")
    held = cut(_sampled(docs, **({"targets": None, "share": 1.0, "seed": 7, "total": None} | how))).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("h").alias(h))
    same = docs["doc_id"].cast("bigint").eqNullSafe(held[d]) & docs["source"].cast("string").eqNullSafe(held[s]) & (_text_key(docs) == held[h])
    return docs.join(held, same, "left_semi")
