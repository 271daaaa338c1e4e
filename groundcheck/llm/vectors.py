"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Cells are two levels of spherical k-means, a centre for each ``CELL`` vectors and ``CELLS`` in all at most, fitted on a
bounded sample (``FIT`` vectors a cell, those with the least hash of their id); every vector is then assigned. Its home is
the nearest fine cell of its nearest coarse cell. It is a guest in every other cell whose centre is within the margin of
the home's cosine, among coarse cells within twice that of the nearest. For a pair at cosine t in homes with centres c and
e, both of the pair's vectors x and y miss the other's cell only if (x - y)(c - e) is over twice the margin; x - y is at
most sqrt(2 - 2t) long and mostly spread over all d dimensions, so the margin is 1.5 sqrt((2 - 2t) / d).

Each cell compares its members with members and guests. Cells are cut into blocks of ``BLOCK`` vectors, and each pair of
blocks is a group of its own, so a hot cell is spread over tasks. A group gives stars, not pairs. Groups of near copies are
connected components; the least vec_id of one stays.

The centres, ``CELLS`` vectors at most, are the only thing that is sent to all executors.

Defined cases: null vec_id, null, empty, zero and non-finite vectors, and vectors of another length than the commonest
(the shorter of two as common), have no row and are no one's copy; equal vectors are copies at cosine 1 and are compared
once; rows that share a vec_id are one; an empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_hot

THRESHOLD, ROUNDS = 0.95, 8
CELL, CELLS, FIT = 256, 128 * 128, 16
BLOCK, STEP = 4096, 1024
PLACED = "cell int, guest boolean, vec_id bigint, v array<float>"


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v, k1, k2) of the vectors that can be compared, with two hashes of the vector; their length."""
    v = vectors["embedding"].cast("array<float>")
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull())).where((square > 1e-24) & (square < 1e30))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = common["n"] if common else 0
    return cut(rows.where(F.size("v") == size).select("*", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))), size


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` unit centres; starts from the first rows, and a cell without members keeps its centre."""
    centres = x[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros(centres.shape)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centres[norm > 1e-9] = (total / np.maximum(norm, 1e-30)[:, None])[norm > 1e-9]
    return centres


class Cells:
    """Coarse centres, and the fine centres of each."""

    def __init__(self, x: np.ndarray, cells: int):
        self.coarse = k_means(x, max(1, round(cells**0.5)))
        own = (x @ self.coarse.T).argmax(axis=1)
        self.fine = [k_means(x[own == c], max(1, round(cells * (own == c).mean()))) if (own == c).any() else self.coarse[c : c + 1] for c in range(len(self.coarse))]
        self.first = np.cumsum([0, *map(len, self.fine)])

    def place(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, guest) of every membership of unit vectors."""
        near = x @ self.coarse.T
        best = near.argmax(axis=1)
        rows, cells, sims, homes = [], [], [], []
        for c, fine in enumerate(self.fine):
            row = np.flatnonzero(near[:, c] >= near[np.arange(len(x)), best] - 2 * margin)
            s = x[row] @ fine.T
            rows.append(np.repeat(row, len(fine))), sims.append(s.ravel())
            cells.append(np.tile(np.arange(len(fine)) + self.first[c], len(row)))
            first = np.zeros(s.shape, bool)
            first[np.arange(len(row)), s.argmax(axis=1)] = best[row] == c
            homes.append(first.ravel())
        row, cell, sim, home = map(np.concatenate, (rows, cells, sims, homes))
        level = np.zeros(len(x), sim.dtype)
        level[row[home]] = sim[home]
        keep = home | (sim >= level[row] - margin)
        return row[keep], cell[keep].astype(np.int32), ~home[keep]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def _pair_edges(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Edges that connect what is near in one pair of blocks of a cell; two guests are not compared."""
    pdf = pdf.sort_values(["guest", "vec_id"])
    ids, x, guest, block = pdf["vec_id"].to_numpy(), _unit(pdf["v"]), pdf["guest"].to_numpy(), pdf["block"].to_numpy()
    same = pdf["i"].iat[0] == pdf["j"].iat[0]
    i = j = np.zeros(0, np.int64)
    for at in range(0, len(x), STEP):
        for to in range(at, len(x), STEP):
            if guest[at] and guest[to]:  # members stand first
                continue
            a, b = np.nonzero(x[at : at + STEP] @ x[to : to + STEP].T >= threshold)
            a, b = a + at, b + to
            ok = (a != b) & ~(guest[a] & guest[b]) & (same | (block[a] != block[b]))
            i, j = np.r_[i, a[ok]], np.r_[j, b[ok]]
        label = _labels(len(x), i, j)  # the pairs so far, as stars
        i = np.flatnonzero(label != np.arange(len(x)))
        j = label[i]
    return pd.DataFrame({"x": ids[i], "y": ids[j]})


def edges(node: DataFrame, n: int, size: int, threshold: float, margin: float | None, block: int) -> DataFrame:
    """(x, y) that connect near vectors among ``n`` distinct ones of length ``size``."""
    spread = 1.5 * ((2 - 2 * threshold) / size) ** 0.5 if margin is None else margin
    cells = min(CELLS, -(-n // CELL))
    sample = node.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(FIT, 2) * max(cells, 16)).select("v").toPandas()  # bounded by CELLS
    shared = node.sparkSession.sparkContext.broadcast(Cells(_unit(sample["v"]), cells))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                row, cell, guest = shared.value.place(_unit(pdf["v"]), spread)
                yield pd.DataFrame({"cell": cell, "guest": guest, "vec_id": pdf["vec_id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row]})

    placed = cut(node.select("vec_id", "v").mapInPandas(place, PLACED))
    blocks = placed.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # CELLS rows at most
    rows = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j")))
    rows = rows.select("cell", "guest", "vec_id", "v", "block", F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")
    return rows.groupBy("cell", "i", "j").applyInPandas(lambda pdf: _pair_edges(pdf, threshold), "x bigint, y bigint")


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, margin: float | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, kept_id, group_size) of every vector that can be compared: it is in the group of ``kept_id``, which stays."""
    rows, size = usable(vectors)
    node = cut(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("vec_id"), F.first("v").alias("v"), F.count("*").alias("n")))
    n, total = node.count(), rows.count()
    copies = node.where("n > 1").select("k1", "k2", F.col("vec_id").alias("y"), "n")
    found = join_hot(rows.select(F.col("vec_id").alias("x"), "k1", "k2"), copies, ["k1", "k2"], F.col("n"), max(1, total)).select("x", "y")
    if n > 1:
        found = found.union(edges(node, n, size, threshold, margin, block))
    found = components(found, "x", "y")
    sizes = cut(found.groupBy("root").agg((F.count("*") + 1).alias("group_size")))
    member = found.join(sizes, "root").select(F.col("node").alias("vec_id"), F.col("root").alias("kept_id"), "group_size")
    member = member.union(sizes.select(F.col("root").alias("vec_id"), F.col("root").alias("kept_id"), "group_size"))
    return rows.select("vec_id").distinct().join(member, "vec_id", "left").select(
        "vec_id", F.coalesce("kept_id", "vec_id").alias("kept_id"), F.coalesce("group_size", F.lit(1)).alias("group_size")
    )
