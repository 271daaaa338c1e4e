"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprint: 96 bits, the sign of the sum of the hashed distinct words (lower case), held as two parts of 48 bits. Two
documents are near copies when their fingerprints differ in at most ``RADIUS`` = 13 bits.

Candidates (Pagh, 2016): each bit of a part gets a vector of GF(2)^7, and each of the 127 non-zero vectors v makes a
mask of the bits whose vector has odd product with v. Two parts that differ in at most 6 bits agree under some mask,
since 6 vectors cannot span 7 dimensions; two fingerprints within 13 bits have a part within 6. So every pair within
the radius meets in one of 254 tables: candidate search loses nothing, and pairs beyond the radius are never reported. A
fingerprint is sent to one place for two tables at a time, by the bits that both their masks have.

A document is a row's (doc_id, text): rows that share a doc_id but not a text are documents of their own, and rows that
repeat both are one document. Of a group (a connected component of near copies) the document with the least (doc_id,
hash of text) stays, so every text that goes has a copy that stays, whatever ids the table repeats.

Defined cases: rows with a null doc_id, and null, empty or wordless texts, have no fingerprint and are no one's copy;
equal fingerprints are copies at distance 0; an empty table gives an empty table; further columns are left out by
``near_copies`` and kept by ``keep_one``. ``doc_id`` and ``kept_id`` can be equal, where a table gives one id to texts
that are near copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, components, cut, fresh, join_hot, map_slices

PART, INNER = 48, 6
RADIUS = 2 * INNER + 1
WORD = re.compile(r"\w+")
SEEDS, CELLS = 64, 1 << 20
#: Fingerprints of one bucket that a task compares; larger buckets are cut into slots, and each pair of slots is a task.
LOAD = 1 << 20


def _masks() -> list[int]:
    """The 127 masks of a part; of 300 draws of the bits' vectors, the one whose sparsest mask keeps most bits."""
    best: list[int] = []
    rng = np.random.default_rng(48)
    for _ in range(300):
        phi = rng.permutation(np.arange(1, 2 ** (INNER + 1)))[:PART]
        masks = [sum(1 << i for i, p in enumerate(phi) if (int(p) & v).bit_count() & 1) for v in range(1, 2 ** (INNER + 1))]
        if not best or min(m.bit_count() for m in masks) > min(m.bit_count() for m in best):
            best = masks
    return best


MASKS = _masks()


def _routes() -> list[tuple[int, int, int]]:
    """(mask, mask, shared bits): the masks by twos (one is alone), such that the fewest bits that two share are many."""
    left, out = list(range(len(MASKS))), []
    while len(left) > 1:
        shared, i, j = max((min((MASKS[i] & MASKS[j]).bit_count(), 12), i, j) for i in left[:1] for j in left[1:])
        out.append((i, j, MASKS[i] & MASKS[j]))
        left = [k for k in left if k not in (i, j)]
    return [*out, *((i, i, MASKS[i]) for i in left)]


#: A fingerprint moves once for two tables of a part: what agrees under either mask agrees in the bits that both have.
ROUTES = _routes()


def fingerprint(text: str | None) -> tuple[int, int] | None:
    """Both parts of a text's fingerprint; None where it has no word."""
    words = set(WORD.findall(text.lower())) if text else ()
    if not words:
        return None
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in words]), np.uint8).reshape(-1, 16)[:, :12]
    bits = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64) * 2 > len(words)
    both = np.packbits(bits.reshape(2, PART), axis=1)
    return int.from_bytes(both[0].tobytes(), "big"), int.from_bytes(both[1].tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, a, b) of every row that has an id and words; h is a hash of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(d, h, *f) for d, h, t in zip(pdf["doc_id"], pdf["h"], pdf["text"]) if (f := fingerprint(t))]
            yield pd.DataFrame(got, columns=["doc_id", "h", "a", "b"], dtype="int64")

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    return map_slices(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), run, "doc_id bigint, h bigint, a bigint, b bigint")


def _near(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of ``i`` (rows) are within the radius of which of ``j`` (columns)."""
    return np.bitwise_count(a[i][:, None] ^ a[j]).astype(np.uint8) + np.bitwise_count(b[i][:, None] ^ b[j]) <= RADIUS


def _grow(a: np.ndarray, b: np.ndarray, free: np.ndarray, found: list[np.ndarray]) -> None:
    """Edges that connect what is connected in one bucket: whole blocks are compared, and each edge takes a member out."""
    while len(free) > 1:
        seeds = free[:SEEDS]
        hit = _near(a, b, seeds, free)
        hit[np.arange(len(seeds)), np.arange(len(seeds))] = False
        some = np.flatnonzero(hit.any(axis=1))
        stay = np.ones(len(free), bool)
        stay[: len(seeds)] = False  # seeds near to no one are done
        stay[some] = True
        if not len(some):
            free = free[stay]
            continue
        stay[some[0]] = False
        frontier, free = free[some[:1]], free[stay]
        while len(frontier) and len(free):
            step = max(1, CELLS // len(free))
            head, frontier = frontier[:step], frontier[step:]
            hit = _near(a, b, head, free)
            got = hit.any(axis=0)
            if got.any():
                new = free[got]
                found.append(np.stack([head[hit[:, got].argmax(axis=0)], new]))
                frontier, free = np.concatenate([frontier, new]), free[~got]


def _bucket_edges(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (positions i, j) that connect what is within the radius in each bucket, and no bucket of an earlier table has."""
    masks = np.array(MASKS * 2, np.int64)
    key = (t.astype(np.int64) << PART) | (np.where(t < len(MASKS), a, b) & masks[t])
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    two = start[size == 2]
    i, j = order[two], order[two + 1]
    ok = np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= RADIUS
    found.append(np.stack([i[ok], j[ok]]))
    for s, n in zip(start[size > 2], size[size > 2]):
        _grow(a, b, order[s : s + n], found)
    pairs = np.concatenate(found, axis=1)
    i, j = pairs
    da, db, at = a[i] ^ a[j], b[i] ^ b[j], t[i]
    first = np.ones(len(i), bool)
    for k, mask in enumerate(MASKS):
        first &= ((da & mask) != 0) | (at <= k)
        first &= ((db & mask) != 0) | (at <= k + len(MASKS))
    return pairs[:, first]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (r, a, b), with or without a pair of slots, in order of their routes' buckets, to edges: a task holds the buckets of
    one batch and the last one before, and tells from them those of each route's two tables."""
    rest = [np.zeros(0, np.int64)] * 4
    masks = np.array([m for _, _, m in ROUTES] * 2, np.int64)
    one, two = (np.array([r[k] + part for part in (0, len(MASKS)) for r in ROUTES], np.int64) for k in (0, 1))

    def edges(cols: list[np.ndarray]) -> pa.RecordBatch:
        r, a, b, _ = cols
        both = one[r] != two[r]
        t, a, b = np.r_[one[r], two[r][both]], np.r_[a, a[both]], np.r_[b, b[both]]
        i, j = _bucket_edges(t, a, b)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[i], b[i], a[j], b[j])], ["a1", "b1", "a2", "b2"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        held.append(columns if len(columns) == 4 else [*columns, np.zeros(len(columns[0]), np.int64)])
        if sum(len(h[0]) for h in held) < 1 << 18:
            continue
        cols = r, a, b, pair = [np.concatenate([x, *[h[k] for h in held]]) for k, x in enumerate(rest)]
        held = []
        key = np.where(r < len(ROUTES), a, b) & masks[r]
        turn = np.flatnonzero((np.diff(r) != 0) | (np.diff(key) != 0) | (np.diff(pair) != 0))
        end = int(turn[-1]) + 1 if len(turn) else 0
        if end:
            yield edges([c[:end] for c in cols])
        rest = [c[end:] for c in cols]
    cols = [np.concatenate([r, *[h[k] for h in held]]) for k, r in enumerate(rest)]
    if len(cols[0]):
        yield edges(cols)


def _key() -> Column:
    """The bucket of a fingerprint on route r."""
    mask = F.element_at(F.array(*[F.lit(m) for _, _, m in ROUTES * 2]), F.col("r") + 1)
    return F.when(F.col("r") < len(ROUTES), F.col("a")).otherwise(F.col("b")).bitwiseAND(mask)


def _routed(nodes: DataFrame) -> DataFrame:
    """(r, a, b): every fingerprint on every route."""
    return nodes.select(F.explode(F.sequence(F.lit(0), F.lit(2 * len(ROUTES) - 1))).alias("r"), "a", "b")


def _placed(nodes: DataFrame, load: int) -> DataFrame:
    """The buckets, sorted within partitions. Which ones are large is told by one fingerprint in ``load / 16``: that decides
    how the work is spread, never what is compared, as any two slots of a bucket meet."""
    rows = _routed(nodes)
    if nodes.count() <= load:  # no bucket can be larger
        return rows.repartition("r", _key()).sortWithinPartitions("r", _key())
    every = max(1, load // 16)
    some = nodes.where(F.pmod(F.xxhash64("b", "a"), F.lit(every)) == 0)
    large = _routed(some).groupBy("r", _key().alias("key")).agg((F.count("*") * every / load).alias("over")).where("over > 0.5")
    rows = rows.withColumn("key", _key()).join(large.select("r", "key", F.ceil("over").cast("int").alias("slots")), ["r", "key"], "left")
    slots = F.coalesce("slots", F.lit(1))
    own = F.pmod(F.xxhash64("a", "b"), slots).cast("int")
    meets = F.transform(F.sequence(F.lit(0), slots - 1), lambda x: F.least(x, own) * slots + F.greatest(x, own))
    pairs = rows.select("r", "a", "b", F.explode(meets).alias("pair"))
    return pairs.repartition("r", _key(), "pair").sortWithinPartitions("r", _key(), "pair")


def groups(docs: DataFrame, load: int = LOAD) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows (doc_id, h, a, b), and groups (a, b, kept_id, kept_h, group_size, n) of those fingerprints
    whose group has more than one document; n is the number of rows that have the fingerprint."""
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("least"), F.max(F.struct("doc_id", "h")).alias("most"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # one for each fingerprint, fixed by being written
    edges = _placed(nodes, load).mapInArrow(_edges, "a1 bigint, b1 bigint, a2 bigint, b2 bigint")
    edges = cut(edges.distinct())
    side = lambda n: nodes.select(F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"), F.col("node").alias(f"n{n}"))
    roots = components(edges.join(side(1), ["a1", "b1"]).join(side(2), ["a2", "b2"]), "n1", "n2")
    of = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = of.groupBy("root").agg(F.min("least").alias("kept"), F.max("most").alias("last"), F.sum("n").alias("group_size")).where("kept <> last")
    found = of.select("root", "a", "b", "n").join(whole, "root")
    return prints, cut(found.select("a", "b", F.col("kept.doc_id").alias("kept_id"), F.col("kept.h").alias("kept_h"), "group_size", "n"))


def _gone(docs: DataFrame) -> DataFrame:
    prints, found = groups(docs)
    rows = join_hot(prints, found, ["a", "b"], F.col("n"), prints.count())
    return rows.where("doc_id <> kept_id OR h <> kept_h").select("doc_id", "h", "kept_id", "kept_h", "group_size").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_id, text_hash, kept_hash, group_size) of every document that goes: it is in the group of the document
    (kept_id, kept_hash), which stays. Hashes of texts are in hexadecimal; the size counts rows, repeated ones included."""
    shown = lambda h: F.lpad(F.hex(h), 16, "0")
    return _gone(docs).select("doc_id", "kept_id", shown(F.col("h")).alias("text_hash"), shown(F.col("kept_h")).alias("kept_hash"), F.col("group_size").cast("decimal(20,0)").alias("group_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that are near copies of one that stays."""
    d, h = fresh(docs, "_gone"), fresh(docs, "_hash")
    gone = carried(cut(_gone(docs)).select(F.col("doc_id").alias(d), F.col("h").alias(h)))
    return docs.join(gone, (docs["doc_id"].cast("bigint") == gone[d]) & (F.xxhash64(docs["text"]) == gone[h]), "left_anti")
