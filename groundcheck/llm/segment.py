"""SentencePiece segmentations: Gumbel top-k sampling without replacement over the lattice, and decoding.

The lattice of a text has an edge for every vocabulary piece at every place; a segmentation's probability is the product
of its pieces', normalised over the lattice. The search is a perturbed A*: a set of segmentations, given by a prefix
and the edges that may not follow it, carries the greatest Gumbel-perturbed log-probability in it. The best set is
popped, its greatest member is drawn with exact lattice posteriors, and the sets that remain beside the member's path
get Gumbels truncated at the popped value. So ``samples`` distinct segmentations come out in order of perturbed value,
as drawn without replacement, and the value next in line gives each its inclusion score (Kool et al., 2019).

Where no piece joins a space to a character before it, or holds a line break, a text is cut there into units whose
lattices are independent, and equal units share one; otherwise a text is one unit. Arrays run over all units and documents
of a block at once, level by level, but for units of over ``LONG`` characters, which have few nodes a level and are gone
through one node at a time. Random numbers are hashes of the row key, the seed and the place, so results do not depend on
partitioning.

A vocabulary with merge ranks for scores (a BPE model, which has no probabilities) gets log-probabilities that fall with
the rank (Zipf): this is a stand-in for a unigram model's, which are kept where a vocabulary has them. Characters outside
the vocabulary become byte pieces. Texts are taken as they are, so a model whose normaliser changes texts is refused.
Every sample is decoded again: ``exact`` says that its ids spell the text.

Defined cases: null texts give no rows; an empty text gives one sample without pieces; a text with fewer segmentations
than ``samples`` gives all of them, with inclusion score 0 (certain); a null key is a key like others; rows with equal
keys and texts get equal samples, drawn once where they stand one after the other; U+2581, which stands for the space,
comes back as a space, and ``exact`` counts it as one; further columns are left out by ``encoded`` and kept by ``decoded``,
which replaces a column of the name it writes.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, lean

SPACE = "▁"
UNIT = re.compile(r"▁+[^▁\n]*|[^▁\n]+|\n+")
SAMPLES, BLOCK_CHARS, LONG = 2, 250_000, 512
PIECE, PIECES = 2048, 32
SCHEMA = "doc_id bigint, sample int, ids array<int>, log_prob double, log_inclusion double, exact boolean"
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((_mix(x) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _gumbel(x: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(_uniform(x)))


def _below(at: np.ndarray, most: np.ndarray | float) -> np.ndarray:
    """Gumbels truncated at ``most``, from free ones ``at``."""
    return -np.logaddexp(-most, -at)


class Vocabulary:
    """Pieces in a hash trie, with log-probabilities."""

    def __init__(self, proto: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.raw = [b""] * size
        self.byte = np.full(256, sp.unk_id(), np.int32)
        plain = []
        probe = "\u2003 \uff21 e\u0301 \ufb01\t\n  "
        if sp.normalize(probe).replace(SPACE, " ").strip(" ") != probe.strip(" "):
            raise ValueError("the model's normaliser changes texts")
        self.unit = UNIT
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte[int(name[3:5], 16)] = i
                self.raw[i] = bytes([int(name[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
                self.raw[i] = name.replace(SPACE, " ").encode()
                if "\n" in name or SPACE in name.lstrip(SPACE):
                    self.unit = re.compile(".+", re.S)  # a piece can run over any cut
        scores = np.array([sp.get_score(i) for i in plain], np.float64)
        if (scores == np.round(scores)).all():  # merge ranks
            scores = -np.log(np.arange(len(plain)) + 3.0)
            scores -= np.log(np.exp(scores).sum())
        self.log_prob = np.full(size, scores.min(), np.float64)
        self.log_prob[plain] = scores
        self.least = float(scores.min())
        moves: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in plain:
            at = 0
            for c in names[i]:
                to = moves.get((at, ord(c)))
                if to is None:
                    to = moves[at, ord(c)] = len(ends)
                    ends.append(-1)
                at = to
            ends[at] = i
        self.piece_at = np.array(ends, np.int32)
        self.longest = max(len(names[i]) for i in plain)
        self.bits = max(10, (len(moves) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        for (at, c), to in moves.items():
            key = at << 21 | c
            h = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits
            while self.keys[h] >= 0:
                h = h + 1 & (1 << self.bits) - 1
            self.keys[h], self.to[h] = key, to

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Trie nodes after one more character; -1 where there is none."""
        key = node.astype(np.int64) << 21 | code
        h = ((key.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)
        held = self.keys[h]
        out = np.where(held == key, self.to[h], -1)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        while len(open_):
            h[open_] = (h[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[h[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.to[h[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        return out


class Lattice:
    """Lattices of distinct units. Nodes are numbered by the characters left in their unit; node ``end`` is every end.

    ``first[n] .. first[n + 1]`` are a node's edges, with piece (-1 for byte pieces), target, posterior and its running sum.
    """

    def __init__(self, vocabulary: Vocabulary, units: list[str]):
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        n = len(codes)
        stop = np.repeat(np.cumsum(sizes), sizes)
        left = stop - np.arange(n)
        long = np.repeat(sizes > LONG, sizes)  # their nodes come last, each unit's together
        level = np.where(long, LONG + 1 + np.repeat(np.arange(len(units)), sizes), left)
        order = np.lexsort((left, level)) if long.any() else np.argsort(left.astype(np.uint16), kind="stable")
        self.thin = n - int(long.sum())
        rank = np.zeros(n + 1, np.int64)
        rank[order] = np.arange(n)
        self.end = n
        levels, count = [], np.zeros(n, np.int64)
        at, node = np.arange(n), np.zeros(n, np.int32)
        lone = np.ones(n, bool)
        for size in range(1, vocabulary.longest + 1):
            live = at + size <= stop[at]
            at, node = at[live], node[live]
            node = vocabulary.step(node, codes[at + size - 1])
            live = node >= 0
            at, node = at[live], node[live]
            if not len(at):
                break
            piece = vocabulary.piece_at[node]
            real = piece >= 0
            here, piece = at[real], piece[real]
            if size == 1:
                lone[here] = False
                other = np.flatnonzero(lone)
                here, piece = np.concatenate([here, other]), np.concatenate([piece, np.full(len(other), -1, np.int32)])
            count[here] += 1
            levels.append((here, piece, size))
        else:
            other = np.zeros(0, np.int64)
        if not levels and n:  # no character starts a piece
            levels.append((np.arange(n), np.full(n, -1, np.int32), 1))
            count[:] = 1
        elif n and (count == 0).any():
            other = np.flatnonzero(count == 0)
            levels.append((other, np.full(len(other), -1, np.int32), 1))
            count[other] = 1
        self.first = np.concatenate([[0], np.cumsum(count[order])])
        edges = int(self.first[-1])
        self.piece, self.target = np.empty(edges, np.int32), np.empty(edges, np.int64)
        self.code = codes[order]  # of the node, for byte pieces
        score = np.empty(edges)
        fill = self.first[rank[:n]].copy()
        for here, piece, size in levels:
            slot = fill[here]
            fill[here] += 1
            self.piece[slot] = piece
            self.target[slot] = np.where(left[here] == size, n, rank[here + size])
            value = vocabulary.log_prob[piece]
            if size == 1:
                odd = np.flatnonzero(piece < 0)
                c = codes[here[odd]]
                value[odd] = vocabulary.least * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            score[slot] = value
        self.q, self.upto = np.empty(edges), np.empty(edges)
        beta = np.zeros(n + 1)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(left[~long], minlength=1)[1:])]) if n else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            lo, hi = self.first[a], self.first[b]
            starts, each = self.first[a:b] - lo, np.diff(self.first[a : b + 1])
            t = score[lo:hi] + beta[self.target[lo:hi]]
            top = np.maximum.reduceat(t, starts)
            t = np.exp(t - np.repeat(top, each))
            total = np.add.reduceat(t, starts)
            beta[a:b] = top + np.log(total)
            t /= np.repeat(total, each)
            self.q[lo:hi] = t
            run = np.cumsum(t)
            self.upto[lo:hi] = run - np.repeat(run[starts] - t[starts], each)
        self._one_by_one(score, beta)
        self.upto[self.first[1:] - 1] = np.inf
        heads = np.cumsum(sizes) - sizes
        self.start = rank[heads] if len(units) else np.zeros(0, np.int64)
        self.held: tuple | None = None

    def _one_by_one(self, score: np.ndarray, beta: np.ndarray) -> None:
        """Posteriors at the nodes of long units."""
        base = int(self.first[self.thin])
        if base == len(score):
            return
        scores, targets, firsts = score[base:].tolist(), self.target[base:].tolist(), (self.first[self.thin :] - base).tolist()
        mine, q, upto = [0.0] * (self.end - self.thin), [], []
        for k in range(len(firsts) - 1):
            t = [scores[e] + (mine[targets[e] - self.thin] if targets[e] < self.end else 0.0) for e in range(firsts[k], firsts[k + 1])]
            top = max(t)
            t = [math.exp(x - top) for x in t]
            total, run = sum(t), 0.0
            mine[k] = top + math.log(total)
            for x in t:
                run += x / total
                q.append(x / total)
                upto.append(run)
        self.q[base:], self.upto[base:], beta[self.thin : self.end] = q, upto, mine

    def _steps(self, node: int, counter: np.uint64) -> list[int]:
        """Edges of the path from a node of a long unit, one by one."""
        out: list[int] = []
        firsts, upto, target, thin = self._lists()
        base, drawn = firsts[0], []
        while node != self.end:
            if not len(out) % 4096:
                drawn = _uniform(counter + (np.arange(len(out), len(out) + 4096).astype(np.uint64)) * U(0xD1342543DE82EF95)).tolist()
            u, e = drawn[len(out) % 4096], firsts[node - thin]
            while upto[e - base] < u:
                e += 1
            out.append(e)
            node = target[e - base]
        return out

    def _lists(self) -> tuple[list[int], list[float], list[int], int]:
        if self.held is None:
            base = int(self.first[self.thin])
            self.held = self.first[self.thin :].tolist(), self.upto[base:].tolist(), self.target[base:].tolist(), self.thin
        return self.held

    def walk(self, node: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path from each node to its unit's end, drawn from the posteriors: edges in order, and their numbers."""
        counts = np.zeros(len(node), np.int64)
        alone = {int(i): self._steps(int(node[i]), counter[i]) for i in np.flatnonzero((node != self.end) & (node >= self.thin))}
        live = np.flatnonzero((node != self.end) & (node < self.thin))
        node, counter = node[live], counter[live]
        steps = []
        while len(live):
            u = _uniform(counter)
            e = self.first[node]
            more = np.flatnonzero(self.upto[e] < u)
            while len(more):
                e[more] += 1
                more = more[self.upto[e[more]] < u[more]]
            steps.append((live, e))
            counts[live] += 1
            node = self.target[e]
            on = node != self.end
            live, node, counter = live[on], node[on], counter[on] + U(0xD1342543DE82EF95)
        for i, edges in alone.items():
            counts[i] = len(edges)
        offset = np.cumsum(counts) - counts
        path = np.empty(int(counts.sum()), np.int64)
        for k, (who, e) in enumerate(steps):
            path[offset[who] + k] = e
        for i, edges in alone.items():
            path[offset[i] : offset[i] + len(edges)] = edges
        return path, counts

    def source(self, edge: int) -> int:
        return int(np.searchsorted(self.first, edge, "right")) - 1


class _Leaves:
    """One segmentation of each document of a block, and the sets that lie beside its path."""

    def __init__(self, lattice: Lattice, path: np.ndarray, unit: np.ndarray, bounds: np.ndarray, value: np.ndarray, fork: np.ndarray, seed: np.ndarray):
        self.path, self.unit, self.bounds, self.value = path, unit, bounds, value
        q = lattice.q[path]
        run = np.concatenate([[0.0], np.cumsum(np.log(q))])
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(path)) - bounds[:-1][doc]
        self.before = run[:-1] - run[bounds[:-1]][doc]
        self.log_prob = run[bounds[1:]] - run[bounds[:-1]]
        with np.errstate(divide="ignore"):
            rest = self.before + np.log1p(-np.minimum(q, 1.0))  # nothing beside an only edge
        self.beside = _below(rest + _gumbel(seed[doc] + place.astype(np.uint64) * U(0x9FB21C651E98DF25)), value[doc])
        self.beside[(place <= fork[doc]) | ~np.isfinite(rest)] = -np.inf

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each document the value of the best set beside the path, and its place on it."""
        sizes = np.diff(self.bounds)
        top, at = np.full(len(sizes), -np.inf), np.full(len(sizes), -1)
        some = np.flatnonzero(sizes)
        if len(some):
            begin = self.bounds[some]
            top[some] = np.maximum.reduceat(self.beside, begin)
            hits = np.flatnonzero(self.beside == np.repeat(top, sizes))
            at[some] = hits[np.searchsorted(hits, begin)] - begin
        return top, at


def sample_block(vocabulary: Vocabulary, texts: list[str], keys: list[object], samples: int, seed: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text its segmentations (ids, log-probability, log inclusion score), greatest perturbed value first."""
    known: dict[str, int] = {}
    code: list[int] = []
    units = np.zeros(len(texts) + 1, np.int64)
    for d, text in enumerate(texts):
        if text:
            code += [known.setdefault(u, len(known)) for u in vocabulary.unit.findall((SPACE + text).replace(" ", SPACE))]
        units[d + 1] = len(code)
    lattice = Lattice(vocabulary, list(known))
    node = lattice.start[np.array(code, np.int64)]
    sizes = np.diff(units)
    doc = np.repeat(np.arange(len(texts)), sizes)
    base = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k!r}") for k in keys], np.uint64)
    inner = (np.arange(len(code)) - units[:-1][doc]).astype(np.uint64) * U(0x9E3779B97F4A7C15)

    def round_seed(r: int) -> np.ndarray:
        return _mix(base + U((r * 2 + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))

    value = _gumbel(_mix(base))
    first = round_seed(0)
    path, counts = lattice.walk(node, first[doc] + inner)
    bounds = np.concatenate([[0], np.cumsum(counts)])[units]
    leaves = [_Leaves(lattice, path, np.repeat(np.arange(len(code)), counts), bounds, value, np.full(len(texts), -1), _mix(first))]
    barred: dict[tuple[int, int, int], list[int]] = {}
    for r in range(1, samples):
        own = round_seed(r)
        u = _uniform(_mix(own))
        start = np.full(len(code), lattice.end, np.int64)
        forks, picks = np.full(len(texts), -1), [None] * len(texts)
        value = np.full(len(texts), -np.inf)
        again = _gumbel(_mix(own + U(1)))
        tops, places = (np.stack(x) for x in zip(*(leaf.best() for leaf in leaves)))
        chosen = tops.argmax(axis=0)
        for d in range(len(texts)):
            which = int(chosen[d])
            top, at, leaf = float(tops[which, d]), int(places[which, d]), leaves[which]
            if top == -np.inf:  # every segmentation has been given
                continue
            where = int(leaf.bounds[d]) + at
            out = barred.setdefault((d, which, at), [int(leaf.path[where])])
            n = lattice.source(out[0])
            lo, hi = int(lattice.first[n]), int(lattice.first[n + 1])
            q = lattice.q[lo:hi].copy()
            q[[e - lo for e in out]] = 0.0
            e = lo + min(int(np.searchsorted(np.cumsum(q), u[d] * q.sum(), "right")), int(np.flatnonzero(q)[-1]))
            out.append(e)
            q[e - lo] = 0.0
            mass = q.sum()
            leaf.beside[where] = _below(leaf.before[where] + np.log(mass) + again[d], top) if mass > 0 else -np.inf
            token = int(leaf.unit[where])
            start[token] = lattice.target[e]
            start[token + 1 : units[d + 1]] = node[token + 1 : units[d + 1]]
            value[d], forks[d], picks[d] = top, at, (which, e, token)
        path, counts = lattice.walk(start, own[doc] + inner)
        unit = np.repeat(np.arange(len(code)), counts)
        ends = np.concatenate([[0], np.cumsum(counts)])[units]
        paths, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        for d, pick in enumerate(picks):
            size = 0
            if pick is not None:
                which, e, token = pick
                leaf = leaves[which]
                head = slice(leaf.bounds[d], leaf.bounds[d] + forks[d])
                paths += [leaf.path[head], np.array([e]), path[ends[d] : ends[d + 1]]]
                tokens += [leaf.unit[head], np.array([token]), unit[ends[d] : ends[d + 1]]]
                size = int(forks[d]) + 1 + int(ends[d + 1] - ends[d])
            bounds[d + 1] = bounds[d] + size
        leaves.append(_Leaves(lattice, np.concatenate(paths), np.concatenate(tokens), bounds, value, forks, _mix(own + U(2))))
    ids = [_ids(vocabulary, lattice, leaf) for leaf in leaves]
    found = []
    limits = np.max([leaf.best()[0] for leaf in leaves], axis=0)
    for d in range(len(texts)):
        limit = float(limits[d])
        rows = []
        for leaf, (flat, cuts) in zip(leaves, ids):
            if leaf.value[d] > -np.inf:
                lp = float(leaf.log_prob[d])
                over = lp - limit
                score = 0.0 if over > 50 else over if over < -30 else float(np.log(-np.expm1(-np.exp(over))))
                rows.append((flat[cuts[d] : cuts[d + 1]], lp, score))
        found.append(rows)
    return found


def _ids(vocabulary: Vocabulary, lattice: Lattice, leaf: _Leaves) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the paths, bytes spelled out, and where each document's begin."""
    ids = lattice.piece[leaf.path]
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, leaf.bounds
    c = lattice.code[np.searchsorted(lattice.first, leaf.path[odd], "right") - 1]
    width = np.ones(len(ids), np.int64)
    extra = (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    width[odd] += extra
    at = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(ids, width)
    lead = np.where(extra == 0, c, np.array([0, 0xC0, 0xE0, 0xF0])[extra] | c >> (6 * extra))
    out[at[odd]] = vocabulary.byte[lead]
    for k in range(1, 4):
        has = extra >= k
        out[at[odd[has]] + k] = vocabulary.byte[0x80 | c[has] >> (6 * (extra[has] - k)) & 0x3F]
    return out, at[leaf.bounds]


def _runs(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The first of each run of equal rows (key, text without nulls), and the rows of the run."""
    n = batch.num_rows
    new = np.ones(n, bool)
    if n > 1:
        key, text = batch.column(0), batch.column(1)
        same = pc.fill_null(pc.equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False)
        none = key.is_null().to_numpy(zero_copy_only=False)
        new[1:] = ~((same | none[1:] & none[:-1]) & pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False))
    at = np.flatnonzero(new)
    return batch.take(pa.array(at)), np.diff(np.r_[at, n])


def _again(rows: pa.RecordBatch, size: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``rows`` with the ``size`` rows of each text ``times`` over, few ids at a time."""
    if (times == 1).all():
        yield rows
        return
    start, offsets = np.cumsum(size) - size, rows.column(2).offsets.to_numpy()
    ids, at = 0, []
    for s, n, k, length in zip(start.tolist(), size.tolist(), times.tolist(), (offsets[start + size] - offsets[start]).tolist()):
        for _ in range(k):
            at.extend(range(s, s + n))
            ids += length + n
            if ids >= BLOCK_CHARS:
                yield rows.take(pa.array(at))
                ids, at = 0, []
    if at:
        yield rows.take(pa.array(at))


def _pieces(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, first, piece): the texts in pieces of ``PIECE`` characters, or ``PIECES`` pieces of a longer text, one after
    the other. A batch sent to Python is a number of rows, so with whole texts long ones would make it large. Pieces are
    counted by bytes, which is quicker, so a text that is not ASCII can have empty ones at its end."""
    rows = docs.select(docs[key].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).where("text IS NOT NULL")
    rows = rows.select("doc_id", "text", F.greatest(F.lit(PIECE), F.ceil(F.octet_length("text") / PIECES).cast("int")).alias("n"))
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("text") / F.col("n")).cast("int") - 1)
    rows = rows.select("doc_id", "text", "n", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return rows.select("doc_id", (F.col("i") == 0).alias("first"), F.col("text").substr(F.col("i") * F.col("n") + 1, F.col("n")).alias("piece"))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``_pieces`` as batches (key, text) of whole texts."""
    held: list[pa.RecordBatch] = []  # the text that the next batch may go on with
    for batch in batches:
        at = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False))
        if len(at):
            if held or at[0]:
                yield _texts([*held, batch.slice(0, at[0])])
            if len(at) > 1:
                yield _texts([batch.slice(at[0], at[-1] - at[0])])
            held = []
            batch = batch.slice(at[-1])
        held.append(batch)
    if held:
        yield _texts(held)


def _texts(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Whole texts from all their pieces, which stand one after the other in memory: only offsets are set anew."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    key, first, piece = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    piece = piece.cast(pa.string())
    at = np.flatnonzero(first.to_numpy(zero_copy_only=False))
    offsets = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1]
    ends = np.append(offsets[at], offsets[-1])
    text = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), piece.buffers()[2])
    return pa.RecordBatch.from_arrays([key.take(pa.array(at)), text], names=["doc_id", "text"])


def encoded(docs: DataFrame, model_path: str, samples: int = SAMPLES, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """Sampled segmentations of every text, one row a sample; one narrow stage, to which only the vocabulary is sent."""
    with io.open(model_path, "rb") as file:
        proto = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(proto.value)

        def block(keys: list, texts: list, times: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = sample_block(vocabulary, texts, keys, samples, seed)
            flat = [(k, s, *row, spelled(vocabulary.raw, row[0]) == t.replace(SPACE, " ")) for k, t, rows in zip(keys, texts, found) for s, row in enumerate(rows)]
            cuts = np.concatenate([[0], np.cumsum([len(f[2]) for f in flat])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *[f[2] for f in flat]]).astype(np.int32)
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in flat], pa.int64()), pa.array([f[1] for f in flat], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(values)),
                    pa.array([f[3] for f in flat], pa.float64()), pa.array([f[4] for f in flat], pa.float64()),
                    pa.array([f[5] for f in flat], pa.bool_()),
                ],
                names=["doc_id", "sample", "ids", "log_prob", "log_inclusion", "exact"],
            )
            yield from _again(rows, np.array([len(f) for f in found], np.int64), times)

        keys, texts, times, chars = [], [], [], 0
        for batch in _whole(batches):
            first, counts = _runs(batch)
            for begin in range(0, first.num_rows, SLICE):
                part = [first.column(k).slice(begin, SLICE).to_pylist() for k in (0, 1)]
                for key, text, n in zip(*part, counts[begin : begin + SLICE].tolist()):
                    if texts and key == keys[-1] and text == texts[-1]:  # the run goes on from the batch before
                        times[-1] += n
                        continue
                    if chars >= BLOCK_CHARS or len(texts) == SLICE:
                        yield from block(keys, texts, np.array(times))
                        keys, texts, times, chars = [], [], [], 0
                    keys.append(key), texts.append(text), times.append(n)
                    chars += len(text)
        if texts:
            yield from block(keys, texts, np.array(times))

    return _pieces(docs, key).mapInArrow(lean(run), SCHEMA)


def decoded(rows: DataFrame, model_path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``rows`` with the text that the piece ids spell; null ids give null, ids outside the vocabulary nothing."""
    with io.open(model_path, "rb") as file:
        proto = rows.sparkSession.sparkContext.broadcast(file.read())
    tables: list[list[bytes]] = []

    @F.pandas_udf("string")
    def spell(column: pd.Series) -> pd.Series:
        if not tables:
            tables.append(Vocabulary(proto.value).raw)
        raw = tables[0]
        return pd.Series([None if x is None else spelled(raw, x) for x in column], dtype=object)

    return rows.withColumn(to, spell(rows[ids]))


def spelled(raw: list[bytes], ids: np.ndarray) -> str:
    """Text of piece ids, without the space that encoding put first."""
    ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
    text = b"".join([raw[i] for i in ids if 0 <= i < len(raw)]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text
