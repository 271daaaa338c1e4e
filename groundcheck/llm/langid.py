"""Language identification of texts that may mix languages.

A language is a distribution over hashed letter trigrams. For each document, expectation-maximisation estimates what
share of its trigrams comes from each language, and the set of languages is the one of greatest penalised likelihood
(BIC): from the best single language on, one is added, dropped or exchanged as long as that gains more than it costs. All
languages are candidates at every step, and no length or share is treated apart. A uniform component "und" stands for text
of no known language; it costs ``2 ln(1 / UNKNOWN)`` on top, its odds before anything is read. A document is rejected where
"und" is its primary language.

Each language is smoothed with ``POOLED`` of the mean of all languages and ``FLAT`` of the uniform distribution: what is
unseen in one language and seen in another is weak evidence for the other, so shares well under ``POOLED`` are not told
from words that the fitted rows lack.

The trigram tables are fitted on a bounded sample of labelled rows, ``ROWS_PER_LANGUAGE`` of each language (those with
the least hash of doc_id and text); every text is then scored in full.

Defined cases: null, empty and letterless texts get no language, primary "und", and are rejected; where no row is
labelled there is nothing to tell languages apart by, so no text has a language and ``accepted`` keeps every row; of
languages with equal likelihood the first by name is primary; rows with a null doc_id are scored like others; repeated
rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import map_slices

ROWS_PER_LANGUAGE = 400
BUCKETS = 1 << 16
POOLED, FLAT, UNKNOWN = 0.02, 0.02, 0.01
OVERLAP = 3  # each letter is in three trigrams, so their evidence is counted a third
SCHEMA = "doc_id bigint, lang string, languages array<string>, shares array<double>, n_grams bigint, score double, accepted boolean"
_LETTER: list[np.ndarray] = []


def grams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the text in lower case, with any run of other than letters as one space."""
    if not text:
        return np.zeros(0, np.int64)
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(1 << 16)]))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[0][np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([np.uint32(32)], np.where(letter, codes, np.uint32(32)), [np.uint32(32)]))
    space = codes == 32
    codes = codes[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


class Model:
    """Probabilities (bucket, component), the background last."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        own = (counts + 1e-9) / (counts + 1e-9).sum(axis=1, keepdims=True)
        smooth = (1 - POOLED - FLAT) * own + POOLED * own.mean(axis=0) + FLAT / BUCKETS if len(own) else own
        self.table = np.concatenate([smooth, np.full((1, BUCKETS), 1 / BUCKETS)]).T.astype(np.float32).copy()

    @staticmethod
    def mixture(p: np.ndarray, rounds: int = 40, close: float = 1e-3) -> tuple[np.ndarray, float]:
        """Shares of the columns of ``p`` and the log-likelihood, by expectation-maximisation."""
        share = np.full(p.shape[1], 1 / p.shape[1], np.float32)
        for _ in range(rounds):
            whole = p @ share
            after = share * ((1 / whole) @ p) / len(p)
            moved = np.abs(after - share).max()
            share = after
            if moved < close:
                break
        return share, float(np.log(p @ share).sum(dtype=np.float64))

    @staticmethod
    def choose(p: np.ndarray) -> tuple[list[int], np.ndarray, float]:
        """The columns of ``p`` of greatest penalised likelihood, the last one the unknown; their shares, the log-likelihood."""
        n, last = len(p), p.shape[1] - 1
        each = OVERLAP * np.log(n + 1.0)
        price = lambda held: each * len(held) + 2 * np.log(1 / UNKNOWN) * (last in held)
        alone = 2 * np.log(p).sum(axis=0, dtype=np.float64)
        alone[last] -= price([last]) - each
        chosen = [int(alone.argmax())]
        share, best = np.ones(1, np.float32), float(np.log(p[:, chosen[0]]).sum(dtype=np.float64))
        while True:
            pull = (1 / (p[:, chosen] @ share.astype(np.float32))) @ p / n
            most = 2 * n * (np.maximum(pull, pull[chosen].max()) - 1)  # the likelihood is concave, so no gain is greater
            others = [int(o) for o in range(last + 1) if o not in chosen]
            tries = [[*chosen, o] for o in others if most[o] > price([*chosen, o]) - price(chosen)]
            if len(chosen) > 1:
                tries += [[c for c in chosen if c != out] for out in chosen]
                tries += [[*[c for c in chosen if c != out], o] for out in chosen for o in others]
            after = max(((2 * ll - price(t), [-i for i in t], s, ll) for t in tries for s, ll in [Model.mixture(p[:, t], 200, 1e-4)]), key=lambda x: x[:2], default=None)
            if after is None or after[0] <= 2 * best - price(chosen) + 1e-6:
                return chosen, share, best
            chosen, share, best = [-i for i in after[1]], after[2], after[3]

    def identify(self, text: str | None) -> tuple[str, list[str], list[float], int, float, bool]:
        """(primary, languages, shares, trigrams, mean log-likelihood, accepted); shares of the chosen set sum to 1."""
        at = grams(text)
        if not len(at) or not self.languages:
            return "und", [], [], len(at), 0.0, False
        p = self.table[at]
        chosen, share, best = self.choose(p)
        names = [*self.languages, "und"]
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], names[chosen[i]]))
        known = [(names[chosen[i]], float(share[i])) for i in order]
        primary = known[0][0]
        return primary, [n for n, _ in known], [round(s, 4) for _, s in known], len(at), round(best / len(at), 6), primary != "und"


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit the trigram tables on a bounded sample of rows with a language; the driver gets one count a bucket and language."""
    sample = (
        docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
        .where("lang IS NOT NULL AND length(text) > 0")
    )
    picked = sample.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"))
    order = W.partitionBy("lang").orderBy("h", "doc_id")
    cutoff = (
        picked.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= rows_per_language)
        .groupBy("lang").agg(F.max("h").alias("h"))
    )
    most = {r["lang"]: r["h"] for r in cutoff.collect()}  # one row a language
    if not most:
        return Model([], np.zeros((0, BUCKETS)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": some.astype(np.int32), "n": n[some]})

    low = F.lit(False)
    for lang, h in most.items():
        low = low | ((F.col("lang") == lang) & (F.xxhash64("doc_id", "text") <= h))
    found = map_slices(sample.where(low).select("lang", "text"), count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    for i, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[i, own["bucket"]] = own["n"]
    return Model(languages, counts)


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Languages of every document; the model (half a megabyte a language) goes to the executors once."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for pdf in batches:
            got = [held.identify(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), **{
                    name: [g[i] for g in got] for i, name in enumerate(("lang", "languages", "shares", "n_grams", "score", "accepted"))
                }})

    return map_slices(docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")), run, SCHEMA)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the documents that are rejected; in one pass, so no join by doc_id is needed."""
    model = model or train(docs)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def fine(text: pa.Array) -> pa.Array:
        held = shared.value
        return pa.array((held.identify(t.as_py())[5] for t in text), pa.bool_())

    return docs.where(fine(docs["text"]))
