"""Unit vectors and exact top-k search, over all passages or only those of the cited references."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Claims and passages of one reference that a task holds at once; more are spread over several tasks.
CLAIMS_PER_TASK, PASSAGES_PER_TASK = 20_000, 1 << 16
#: Queries and vectors whose products a task holds at once.
TILE = (256, 4096)
#: Blocks of a side in the search over all passages, of at least ``LEAST`` vectors, until a block is full.
GRID, LEAST = 12, 1024


class Embedder(Protocol):
    """A model: texts to vectors of one length."""

    dimension: int

    def encode(self, batch: Sequence[str]) -> Sequence[Sequence[float]]: ...


@lru_cache(1 << 16)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")


class HashEmbedder:
    """A deterministic stand-in for a model: signed word hashes, unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def encode(self, batch: Sequence[str]) -> Sequence[Sequence[float]]:
        out = []
        for text in batch:
            v = [0.0] * self.dimension
            for word, n in Counter(re.findall(r"\w+", text.lower())).items():
                h = _word_hash(word)
                v[h % self.dimension] += n if h >> 63 else -n
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


def embed(rows: DataFrame, embedder: Embedder, text: str = "text", to: str = "embedding") -> DataFrame:
    """``rows`` with unit vectors of a text column, a batch a call."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array(embedder.encode(texts.fillna("").tolist()), np.float64).reshape(len(texts), embedder.dimension)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list((x / np.where(size > 0, size, 1.0)).astype(np.float32)), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(to, F.pandas_udf(run, "array<float>")(rows[text]))


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    size = F.sqrt(_square(v))
    return F.when(size > 0, F.transform(v, lambda x: (x / size).cast("float"))).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def in_scope(passages: DataFrame, refs: DataFrame) -> DataFrame:
    """Passages of the given references."""
    return passages.join(refs.select(F.col("id").alias("reference_id")).distinct(), "reference_id", "left_semi")


def _top(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    order = W.partitionBy("claim_id").orderBy(F.desc(score), "embedding_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's k best vectors: score to six places, ties by id.

    Tile by tile; what is below the k-th best so far of its query is passed over, so memory is that of a tile, at any size.
    """
    found = []
    for top in range(0, len(q), TILE[0]):
        part = q[top : top + TILE[0]].astype(np.float64)
        row, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(part), -np.inf)
        for left in range(0, len(x), TILE[1]):
            s = part @ x[left : left + TILE[1]].astype(np.float64).T
            n = s.shape[1]
            bound = np.partition(s, n - k, axis=1)[:, n - k] if not left and k < n else least
            slack = np.where(np.isfinite(bound), 1e-6 + abs(bound) * 1e-12, 0.0)  # what rounding can add
            r, a = np.divmod(np.flatnonzero(s >= (bound - slack)[:, None]), n)
            if not len(r):
                continue
            row, at, score = np.concatenate([row, r]), np.concatenate([at, a + left]), np.concatenate([score, np.round(s[r, a], 6)])
            order = np.lexsort((ids[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            row, at, score, place = row[keep], at[keep], score[keep], place[keep]
            least[row[place == k - 1]] = score[place == k - 1]
        found.append((row + top, at, score))
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def _searched(left: DataFrame, right: DataFrame, keys: list[str], kind: str, k: int) -> DataFrame:
    """(claim_id, embedding_id, score): in each group of ``keys`` the k best vectors of ``right`` for each query of ``left``."""
    left, right = left.select(*keys, "claim_id", "q"), right.select(*keys, "embedding_id", "embedding")

    def group(claims: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        who, ids = claims["claim_id"], held["embedding_id"]
        if not len(claims) or not len(held):
            return pd.DataFrame({"claim_id": who[:0], "embedding_id": ids[:0], "score": np.zeros(0)})
        q, x = (np.stack(c.to_numpy()) for c in (claims["q"], held["embedding"]))
        row, at, score = _best(q, ids.to_numpy(), x, k)
        return pd.DataFrame({"claim_id": who.to_numpy()[row], "embedding_id": ids.to_numpy()[at], "score": score})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(group, f"claim_id {kind}, embedding_id bigint, score double")


def _described(top: DataFrame, passages: DataFrame) -> DataFrame:
    keep = [c for c in ("id", "reference_id", "text") if c in passages.columns]
    return top.join(passages.select("embedding_id", *keep), "embedding_id") if keep else top


def top_scoped(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The k best passages of each claim among those of the references it cites: a co-group on the reference.

    Each group leaves k rows a claim and reference. The claims and the passages of a much cited or long reference are spread
    over as many groups as their numbers ask for; passages that no claim cites are dropped before they are moved. Rows
    (claim_id, embedding_id, id, reference_id, text, score, rank).
    """
    cited = queries.select("claim_id", F.col("embedding").alias("q"), F.explode(F.array_distinct("cited_reference_ids")).alias("reference_id"))
    many = lambda d, n, name: d.groupBy("reference_id").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    spread = many(cited, CLAIMS_PER_TASK, "slots").join(many(passages, PASSAGES_PER_TASK, "parts"), "reference_id")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = cited.join(spread, "reference_id").withColumns({"slot": at("claim_id", "slots"), "part": each("parts")})
    right = passages.select("reference_id", "embedding_id", "embedding").join(spread, "reference_id").withColumns({"part": at("embedding_id", "parts"), "slot": each("slots")})
    found = _searched(left, right, ["reference_id", "slot", "part"], dict(queries.dtypes)["claim_id"], k)
    return _described(_top(found, k), passages)


def top_full(queries: DataFrame, passages: DataFrame, k: int, block: int = 1 << 16, held: int = 1 << 16) -> DataFrame:
    """The k best passages of each claim among all, by blocked matrix products; one plan at every size.

    Queries and passages are cut into blocks of at most about ``block`` and ``held`` vectors by hash, and each pair of blocks
    is a group of its own, which leaves k rows a query. Nothing is sent to the driver or to all tasks. Each vector is moved
    once for every block of the other side: ``GRID`` times at most until the blocks are full.
    """
    asked = queries.select("claim_id", F.col("embedding").alias("q"))
    blocks = lambda n, most: max(1, -(-n // most), min(GRID, -(-n // LEAST)))
    rows, columns = blocks(asked.count(), block), blocks(passages.count(), held)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumns({"i": F.pmod(F.xxhash64("claim_id"), F.lit(rows)).cast("int"), "j": every(columns)})
    right = passages.select("embedding_id", "embedding", F.pmod(F.xxhash64("embedding_id"), F.lit(columns)).cast("int").alias("j"), every(rows).alias("i"))
    if rows * columns > 1:  # few bytes are much work, so tasks are not merged
        left, right = (d.repartition(rows * columns, "i", "j") for d in (left, right))
    return _described(_top(_searched(left, right, ["i", "j"], dict(asked.dtypes)["claim_id"], k), k), passages)
