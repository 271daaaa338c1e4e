"""Substring duplicates by relative Lempel-Ziv parsing against the whole corpus.

Reference blocks are all windows of ``MIN_WORDS`` words of all documents, indexed by hash and spread over the cluster by
it; each window is named by its first occurrence (least document, then place). A document is then a sequence of runs of
windows that continue one first occurrence. It is factored greedily: a factor starts where the one before it ends and is
the match in an earlier document that covers this boundary and reaches furthest (ties: the least document, then place).

Candidates are the earlier documents that have a window of it first, and those that are the first to have two of its
successive runs in a row. Each match is extended to its true ends by comparing the names of windows before and behind it
in both documents, so a factor is checked at its two boundaries and is as long as its source allows. Of several earlier
documents with the same windows, one that is first in none of these ways is no candidate: factors can then be more than
with all sources, but never cover other words. Matches of less than ``MIN_WORDS`` words are literals. What factors cover
becomes duplicate spans, so the first occurrence of a passage stays and every later one is reported.

Two passes keep the index small without losing a factor. Winnowing picks one of any 26 successive 25-word windows by
least hash, so that any repeated run of 50 words has a picked window in common; only 50-word windows whose picked window
another document has picked too are indexed, each of them. Windows are matched by 64 bits of hash, and by 31 more against
the first of their hash. What more than ``LOAD`` picks have in common is aggregated before it is moved, so a passage that
is everywhere meets in no one task.

A document is a row's (doc_id, text): rows that share a doc_id but not a text are documents of their own, in the order of a
hash of their text, and their spans carry that hash as ``text_key`` (0 for ids that have one text). Rows that repeat both
are one document and get the same spans.

Defined cases: words are runs of bytes over 32; rows with a null doc_id and null, empty or short texts have no factor;
repeats within one document are not duplicates of another and stay; an empty table gives an empty table; further columns
are left out by ``factors`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, fresh, join_hot, lean, map_slices, slices

MIN_WORDS, GRAM = 50, 25
#: Occurrences of one key that a task may hold, and ids with several texts that are broadcast.
LOAD, CLASHES = 1 << 20, 100_000
#: Documents whose runs, and those of their sources, are Python objects at one time.
PARSED = 20
_RNG = np.random.default_rng(2011)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASES = [(0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64; negative bases stand for inverses."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024) * 2, pow(-base, -1, 2**64) if base < 0 else base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the starts and ends of the words."""
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = np.frombuffer(raw, np.uint8) > 32
    turn = np.diff(solid)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    base = _BASES[0][0]
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * _powers(base, n), out=total[1:])
    return _mix((total[ends] - total[starts]) * _powers(-base, n + 1)[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(base, n), out=total[1:])
    return _mix((total[size:] - total[:-size]) * _powers(-base, n)[: n - size + 1])


def least_grams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 50-word window, the position of the 25-word window in it that winnowing picks; the 25-word hashes."""
    gram = windows(hashes, GRAM, _BASES[0][1])
    span = MIN_WORDS - GRAM + 1
    if len(gram) < span:
        return np.zeros(0, np.int64), gram
    return np.lib.stride_tricks.sliding_window_view(gram, span).argmin(axis=1) + np.arange(len(gram) - span + 1), gram


def _pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        size, at, keys = [], [], []
        for text in pdf["text"]:
            raw = text.encode("utf-8", "surrogatepass")
            least, gram = least_grams(word_hashes(raw, *words(raw)))
            p = least[np.flatnonzero(np.diff(least, prepend=-1))]
            size.append(len(p)), at.append(p), keys.append(gram[p])
        yield _rows(pdf, size, key=np.concatenate(keys).view(np.int64), pos=np.concatenate(at).astype(np.int32))


def _rows(pdf: pd.DataFrame, size: list[int], **columns: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": np.repeat(pdf["doc_id"].to_numpy(), size), "k": np.repeat(pdf["k"].to_numpy(), size), **columns})


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every 50-word window whose picked 25-word window is at a shared place; meta is 31 bits of hash and the place."""
    for pdf in batches:
        size, meta, keys = [], [], []
        for text, shared in zip(pdf["text"], pdf["shared"]):
            raw = text.encode("utf-8", "surrogatepass")
            hashes = word_hashes(raw, *words(raw))
            least, gram = least_grams(hashes)
            hit = np.zeros(len(gram), bool)
            hit[shared[shared < len(gram)]] = True
            where = np.flatnonzero(hit[least])
            size.append(len(where)), keys.append(windows(hashes, MIN_WORDS, _BASES[0][1])[where])
            check = windows(hashes, MIN_WORDS, _BASES[1][1])[where] >> np.uint64(33)
            meta.append((check << np.uint64(32)) | where.astype(np.uint64))
        yield _rows(pdf, size, key=np.concatenate(keys).view(np.int64), meta=np.concatenate(meta).view(np.int64))


RUNS = "doc_id bigint, k bigint, pos int, n int, src bigint, sk bigint, at int, before_src bigint, before_sk bigint, before_at int"
SPANS = "doc_id bigint, k bigint, start int, stop int, source_id bigint, sk bigint, source_start int, factors int"


def _shape(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "bigint" else pa.int32()) for name, kind in (c.split() for c in ddl.split(", "))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, k, pos, src, sk, at), sorted by doc_id, k and pos, to ``RUNS``: maximal runs that continue one occurrence,
    with the last window of the run right before, where there is one."""
    shape, names = _shape(RUNS), ("doc_id", "k", "pos", "src", "sk", "at")
    last: tuple | None = None  # the open run: doc, k, pos, n, src, sk, at, before (3)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    for part in batches:
        if not part.num_rows:
            continue
        doc, k, pos, src, sk, at = (part.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
        again = np.r_[False, (np.diff(doc) == 0) & (np.diff(k) == 0) & (np.diff(pos) == 0)]
        doc, k, pos, src, sk, at = (x[~again] for x in (doc, k, pos, src, sk, at))
        fresh_ = (np.diff(doc) != 0) | (np.diff(k) != 0) | (np.diff(pos) != 1) | (np.diff(src) != 0) | (np.diff(sk) != 0) | (np.diff(at) != 1)
        begin = np.flatnonzero(np.r_[True, fresh_])
        size = np.diff(np.r_[begin, len(doc)])
        out = []
        for b, n in zip(begin.tolist(), size.tolist()):
            d, kk, p, s, ss, a = int(doc[b]), int(k[b]), int(pos[b]), int(src[b]), int(sk[b]), int(at[b])
            if last and (d, kk) == last[:2]:
                end, gap = last[2] + last[3], p - (last[2] + last[3])
                if gap < 0:  # a row that the batch before had too
                    b, n, p, a = b - gap, n + gap, p - gap, a - gap
                    gap = 0
                    if n <= 0:
                        continue
                if gap == 0 and (s, ss) == last[4:6] and a == last[6] + last[3]:
                    last = (*last[:3], last[3] + n, *last[4:])
                    continue
                before = (last[4], last[5], last[6] + last[3] - 1) if p == end else (None, None, None)
            else:
                before = (None, None, None)
            if last:
                out.append(last)
            last = (d, kk, p, n, s, ss, a, *before)
        yield batch(out)
    if last:
        yield batch([last])


class _Names:
    """Windows of a document by name: (document, place) of their first occurrence, by runs; elsewhere a window is its own."""

    def __init__(self, own: tuple[int, int], runs: list[dict]):
        self.own = own
        self.runs = sorted((r["pos"], r["n"], (r["src"], r["sk"]), r["at"]) for r in runs)
        self.starts = [r[0] for r in self.runs]

    def piece(self, p: int) -> tuple[tuple[int, int], int, int, int, bool]:
        """(document, place of p in it, first window, last window, whether it is a run) of the stretch that p is in."""
        i = bisect_right(self.starts, p) - 1
        if i >= 0 and p < self.runs[i][0] + self.runs[i][1]:
            pos, n, src, at = self.runs[i]
            return src, at + p - pos, pos, pos + n - 1, True
        low = self.runs[i][0] + self.runs[i][1] if i >= 0 else -(1 << 40)
        high = self.runs[i + 1][0] - 1 if i + 1 < len(self.runs) else 1 << 40
        return self.own, p, low, high, False


def _extend(mine: _Names, other: _Names, p: int, q: int) -> tuple[int, int]:
    """First and last window around p of ``mine`` that continue the match of p with q of ``other``."""
    ends = []
    for step in (-1, 1):
        here, there = p, q
        while True:
            a, b = mine.piece(here), other.piece(there)
            if not a[4] or a[:2] != b[:2]:
                ends.append(here - step)
                break
            side = 2 if step < 0 else 3
            n = min(abs(a[side] - here), abs(b[side] - there)) + 1
            here, there = here + step * n, there + step * n
    return ends[0], ends[1]


def parse(own: tuple[int, int], runs: list[dict], seeds: list[dict], sources: dict[tuple[int, int], list[dict]]) -> list[tuple]:
    """Spans (start, stop, source, source key, place, factors) of one document from its runs and candidate matches."""
    mine, names = _Names(own, runs), {}
    found: dict[tuple, list[tuple[int, int]]] = {}
    for s in sorted(seeds, key=lambda s: s["pos"]):
        source, shift = (s["src"], s["sk"]), s["at"] - s["pos"]
        held = found.setdefault((*source, shift), [])
        if not held or s["pos"] > held[-1][1]:
            if source not in names:
                names[source] = _Names(source, sources.get(source, []))
            held.append(_extend(mine, names[source], s["pos"], s["at"]))
    matches = sorted((low, -(high + MIN_WORDS), *key[:2], low + key[2]) for key, held in found.items() for low, high in held if low <= high)
    covered = [(pos, pos + n - 1) for pos, n, src, _ in mine.runs if src != own]
    chains: list[list[int]] = []
    for low, high in covered:
        if chains and low - chains[-1][1] <= MIN_WORDS:
            chains[-1][1] = high
        else:
            chains.append([low, high])
    out, at = [], 0
    best: tuple | None = None
    for low, high in chains:
        here, count, longest = low, 0, None
        while here < high + MIN_WORDS:
            while at < len(matches) and matches[at][0] <= here:
                if best is None or matches[at][1:5] < best[1:5]:  # reaches further, or as far from an earlier document
                    best = matches[at]
                at += 1
            stop = -best[1]
            if longest is None or stop - here > longest[0]:
                longest = (stop - here, *best[2:4], best[4] + here - best[0])
            count, here = count + 1, stop
        out.append((low, here, *longest[1:], count))
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = _shape(SPANS)
    for part in slices(batches, PARSED):
        rows = []
        for r in part.to_pylist():
            own = (r["doc_id"], r["k"])
            sources = {(x["src"], x["sk"]): x["runs"] or [] for x in r["sources"] or []}
            rows += [(*own, *span) for span in parse(own, r["runs"], r["seeds"], sources)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(shape)], schema=shape)


def _keys(docs: DataFrame) -> tuple[Column, DataFrame | None]:
    """What tells the texts of one id apart: a hash of the text for ids that have several texts, 0 for others. The ids are few
    enough to be broadcast (the table to join is given), or every row has its hash; the order of documents is the same."""
    h = F.xxhash64("text")
    several = docs.select(F.col("doc_id").cast("bigint").alias("_several"), h.alias("h")).where("_several IS NOT NULL").groupBy("_several")
    several = cut(several.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("_several"))
    n = several.limit(CLASHES + 1).count()
    if not n:
        return F.lit(0).cast("bigint"), None
    if n > CLASHES:
        return h, None
    return F.when(F.col("_several").isNotNull(), h).otherwise(F.lit(0).cast("bigint")), F.broadcast(several)


def _keyed(docs: DataFrame, keys: tuple[Column, DataFrame | None]) -> DataFrame:
    """(doc_id, k, text) of the rows that have a document."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows if keys[1] is None else rows.join(keys[1], rows["doc_id"] == keys[1]["_several"], "left")
    return rows.select("doc_id", keys[0].alias("k"), "text")


def _hot(picks: DataFrame, load: int) -> DataFrame | None:
    """Keys that about ``load`` picks or more have, as one pick in ``load / 16`` tells; that decides how rows are moved, never
    which windows are found."""
    if picks.count() <= load:
        return None
    every = max(1, load // 16)
    some = picks.where(F.pmod(F.xxhash64("pos", "k", "doc_id"), F.lit(every)) == 0).groupBy("key").agg(F.count("*").alias("n"))
    hot = cut(some.where(F.col("n") * every > load / 2).select("key"))
    return hot if hot.limit(1).count() else None


def factors(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """Duplicate spans (doc_id, start, stop, source_id, source_start, factors, text_key, source_key), in words.

    Spans of a document do not touch. ``factors`` counts the greedy factors of the span; the source is the longest's.
    """
    return _shown(_factors(_keyed(docs, _keys(docs)), load))


def _shown(spans: DataFrame) -> DataFrame:
    text = lambda c: F.lpad(F.hex(c), 16, "0")
    return spans.select("doc_id", "start", "stop", "source_id", "source_start", "factors", text("k").alias("text_key"), text("sk").alias("source_key"))


def _factors(rows: DataFrame, load: int) -> DataFrame:
    rows = rows.where(F.octet_length("text") >= 2 * MIN_WORDS - 1)
    picks = cut(map_slices(rows, _pick, "doc_id bigint, k bigint, key bigint, pos int"))
    hot = _hot(picks, load)
    own = F.struct("doc_id", "k")
    same = W.partitionBy("key")
    if hot is None:
        found = _first(rows, picks.select("doc_id", "k", "pos", (F.min(own).over(same) != F.max(own).over(same)).alias("both")).where("both"), False)
    else:
        rare = picks.join(hot, "key", "left_anti").select("doc_id", "k", "pos", (F.min(own).over(same) != F.max(own).over(same)).alias("both"))
        often = picks.join(hot, "key", "left_semi")
        shared = often.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select("key")
        found = _first(rows, rare.where("both"), False).union(_first(rows, often.join(shared, "key", "left_semi"), True))
    found = found.select("doc_id", "k", "pos", "src", "sk", "at").repartition("doc_id", "k").sortWithinPartitions("doc_id", "k", "pos")
    return _joined(cut(found.mapInArrow(lean(_runs), RUNS)))


def _joined(runs: DataFrame) -> DataFrame:
    """Spans, from the runs of all documents: each with its candidate matches and the runs of the documents these are in."""
    other = "(src <> doc_id OR sk <> k)"
    before = ["before_src", "before_sk", "before_at", "src", "sk", "at"]
    pairs = runs.where("before_src IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").alias("d"), F.col("k").alias("e"), F.col("pos").alias("p")))
    first = pairs.groupBy(*before).agg(least.alias("f"), F.count("*").alias("m"))
    met = join_hot(pairs, first, before, F.col("m"), runs.count()).where("f.d <> doc_id OR f.e <> k").select("doc_id", "k", "pos", F.col("f.d").alias("src"), F.col("f.e").alias("sk"), F.col("f.p").alias("at"))
    seeds = cut(runs.where(other).select("doc_id", "k", "pos", "src", "sk", "at").union(met))
    whole = runs.groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "n", "src", "sk", "at")).alias("runs"))
    asked = cut(seeds.select("doc_id", "k", "src", "sk").distinct())
    n = asked.groupBy("src", "sk").agg(F.count("*").alias("n"))
    held = n.join(whole.select(F.col("doc_id").alias("src"), F.col("k").alias("sk"), "runs"), ["src", "sk"])
    given = join_hot(asked, held, ["src", "sk"], F.col("n"), asked.count())
    given = given.groupBy("doc_id", "k").agg(F.collect_list(F.struct("src", "sk", "runs")).alias("sources"))
    mine = whole.join(seeds.groupBy("doc_id", "k").agg(F.collect_list(F.struct("pos", "src", "sk", "at")).alias("seeds")), ["doc_id", "k"])
    return mine.join(given, ["doc_id", "k"], "left").select("doc_id", "k", "runs", "seeds", "sources").mapInArrow(lean(_parse), SPANS)


def _first(rows: DataFrame, shared: DataFrame, hot: bool) -> DataFrame:
    """(doc_id, k, pos, src, sk, at) of the windows over shared places that have occurred before, here or in another document."""
    places = shared.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("shared"))
    held = map_slices(rows.join(places, ["doc_id", "k"]).select("doc_id", "k", "text", "shared"), _index, "doc_id bigint, k bigint, key bigint, meta bigint")
    least = F.min(F.struct(F.col("doc_id").alias("d"), F.col("k").alias("k"), F.col("meta").alias("m")))
    if hot:
        held = cut(held)
        found = held.join(held.groupBy("key").agg(least.alias("first")), "key")
    else:
        found = held.withColumn("first", least.over(W.partitionBy("key")))
    place = lambda m: m.bitwiseAND(0xFFFFFFFF).cast("int")
    found = found.select("doc_id", "k", "meta", "first").where("(first.d <> doc_id OR first.k <> k OR first.m <> meta) AND shiftright(first.m, 32) = shiftright(meta, 32)")
    return found.select("doc_id", "k", place(F.col("meta")).alias("pos"), F.col("first.d").alias("src"), F.col("first.k").alias("sk"), place(F.col("first.m")).alias("at"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans, and without the white space that follows each."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = words(raw)
    keep, at = [], 0
    for start, stop in sorted(spans):
        if start < len(starts):
            keep.append(raw[at : max(at, starts[start])])
            at = starts[stop] if stop < len(starts) else len(raw)
    keep.append(raw[at:])
    return b"".join(keep).decode("utf-8", "surrogatepass").strip() if spans else text


def without_repeats(docs: DataFrame, load: int = LOAD) -> DataFrame:
    """``docs`` with the duplicate spans taken out of the text (and n_chars set anew); documents left empty by that go."""
    d, k, held = fresh(docs, "_doc"), fresh(docs, "_k"), fresh(docs, "_spans")
    keys = _keys(docs)
    spans = cut(_factors(_keyed(docs, keys), load)).groupBy(F.col("doc_id").alias(d), F.col("k").alias(k)).agg(F.collect_list(F.struct("start", "stop")).alias(held))

    @F.arrow_udf("string")
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = ((t.as_py(), s.as_py()) for t, s in zip(text, spans))
        return pa.array((cut_out(t, [(s["start"], s["stop"]) for s in x]) if x else t for t, x in out), pa.string())

    clean = clean.asNondeterministic()  # or the filter below would evaluate it a second time
    same = (docs["doc_id"].cast("bigint") == spans[d]) & ((spans[k] == 0) | (spans[k] == F.xxhash64(docs["text"])))
    out = docs.join(spans, same, "left")
    out = out.withColumn("text", F.when(F.col(held).isNull(), F.col("text")).otherwise(clean(F.col("text"), F.col(held)))).where(F.col(held).isNull() | (F.length("text") > 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*docs.columns)
