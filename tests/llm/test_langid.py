from __future__ import annotations

import numpy as np
import pytest

from groundcheck.llm import langid


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.toPandas()
    model = langid.train(docs.where("doc_id % 2 = 0"), 60)
    return model, rows


def test_held_out_accuracy(fitted):
    model, rows = fitted
    held = rows[(rows["doc_id"] % 2 == 1) & (rows["n_chars"] >= 60)]
    got = [model.identify(t) for t in held["text"]]
    assert np.mean([g[0] == l for g, l in zip(got, held["lang"])]) > 0.98
    assert all(g[5] for g in got)


def test_mixtures(fitted):
    model, rows = fitted
    pick = {l: " ".join(rows[(rows["lang"] == l) & (rows["doc_id"] % 2 == 1)]["text"].head(40))[:9000] for l in model.languages}
    for a, b, part in (("en", "de", 3000), ("fr", "es", 6000), ("de", "fr", 1500)):
        primary, names, shares, n, _, ok = model.identify(pick[a][:6000] + " " + pick[b][:part])
        assert set(names) == {a, b} and ok
        assert dict(zip(names, shares))[b] == pytest.approx(part / (6000 + part), abs=0.06) and sum(shares) == pytest.approx(1, abs=1e-3)


def test_mixture_is_the_likelihood_maximum():
    rng = np.random.default_rng(0)
    p = rng.random((300, 3)).astype(np.float32)
    share, ll = langid.Model.mixture(p, rounds=2000, close=1e-9)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)]
    best = max(grid, key=lambda s: np.log(p @ np.array(s) + 1e-30).sum())
    assert ll >= np.log(p @ np.array(best) + 1e-30).sum() - 1e-2 and np.abs(share - best).max() < 0.03


def test_grams_against_brute_force():
    text = "Ab, c\n\n9d-É!"
    clean = " ab c d é "
    got = langid.grams(text)
    assert len(got) == len(clean) - 2
    assert (got == langid.grams("ab  c d é")).all() and len(set(got)) == len({clean[i : i + 3] for i in range(len(clean) - 2)})
    assert len(langid.grams(None)) == len(langid.grams("")) == len(langid.grams("12 !?")) == 0
    assert len(langid.grams("日本 \U00020000x")) > 0


def test_odd_rows(spark, odd, none, fitted):
    rows = langid.identified(odd, fitted[0]).collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert all(not by[d]["accepted"] and by[d]["lang"] == "und" and by[d]["languages"] == [] for d in (2, 3, 4, 5))
    assert by[1]["accepted"] and by[1]["lang"] == "en"
    kept = langid.accepted(odd, fitted[0])
    assert kept.columns == odd.columns
    assert [r["doc_id"] for r in kept.collect()].count(1) == 2
    assert langid.identified(none).collect() == [] and langid.accepted(none).collect() == []


def test_unknown_language_needs_evidence(fitted):
    model, _ = fitted
    strange = "ქართული ენა არის ლამაზი და ძველი ენა საქართველოში და სხვაგან"
    assert model.identify(strange)[0] == "und" and not model.identify(strange)[5]
    assert model.identify("Von.")[0] == "de"
    for text in ("Это русский", "ქართული ენა", "ქართ", "Ελληνικά"):
        assert model.identify(text)[0] == "und" and not model.identify(text)[5]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "", "en")], "doc_id bigint, text string, lang string")
    rows = langid.identified(docs).collect()
    assert [r["accepted"] for r in rows] == [False] * 3 and langid.accepted(docs).count() == 3


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", "en") for i in range(50)] + [(i, "ein wort", "de") for i in range(3)], "doc_id bigint, text string, lang string")
    model = langid.train(docs, 10)
    assert model.languages == ["de", "en"]
    whole = langid.train(docs, 1000)
    assert not np.allclose(model.table, whole.table, atol=0)


def test_small_part_of_a_long_text(fitted):
    model, rows = fitted
    words = {l: " ".join(t for t in rows[(rows["lang"] == l) & (rows["doc_id"] % 2 == 1)]["text"] if t).split() for l in ("en", "de", "fr")}
    long = words["en"][:15_000]
    alone = model.identify(" ".join(long))
    assert len(long) > 8_000 and alone[1] == ["en"]
    for part in (0.02, 0.01):
        second = words["de"][: int(part * len(long))]
        primary, names, shares, n, _, ok = model.identify(" ".join(long + second))
        want = len(langid.grams(" ".join(second))) / n
        assert names == ["en", "de"] and primary == "en" and ok and shares[1] == pytest.approx(want, abs=0.007)
    four = words["fr"][: int(0.04 * len(long))]
    assert model.identify(" ".join(long + four))[1] == ["en", "fr"]
    three = model.identify(" ".join(long + words["de"][:150] + words["fr"][:150]))
    assert three[1][0] == "en" and {"en", "de", "fr"} <= set(three[1])


def test_every_language_is_tried():
    counts = np.zeros((6, langid.BUCKETS))
    texts = [" ".join(f"{a}{b}{c}" for b in "lmnr" for c in "aeiou") for a in "bcdfgk"]
    for i, t in enumerate(texts):
        counts[i] += 50 * np.bincount(langid.grams(t), minlength=langid.BUCKETS)
    model = langid.Model(list("bcdfgk"), counts)
    got = model.identify(" ".join([texts[0]] * 200 + [t for t in texts[1:] for _ in range(4)]))
    assert set(got[1]) == set("bcdfgk") and got[0] == "b"


def test_the_set_is_the_best_of_all_sets(fitted):
    from itertools import combinations

    model, rows = fitted
    texts = {l: " ".join(t for t in rows[(rows["lang"] == l) & (rows["doc_id"] % 2 == 1)]["text"] if t) for l in model.languages}
    rng = np.random.default_rng(8)
    cases = [t for t in rows[rows["doc_id"] % 2 == 1]["text"].head(60) if t]
    for _ in range(60):
        parts = [(l, int(rng.integers(20, 4000))) for l in rng.permutation(model.languages)[: rng.integers(1, 5)]]
        cases.append(" ".join(texts[l][at : at + n] for l, n in parts for at in [int(rng.integers(0, len(texts[l]) - n))]) + " это не то" * int(rng.integers(0, 2) * 20))
    for text in cases:
        p = model.table[langid.grams(text)]
        if not len(p):
            continue
        last = p.shape[1] - 1

        def score(held: tuple[int, ...]) -> float:
            ll = langid.Model.mixture(p[:, list(held)], 2000, 1e-6)[1]
            return 2 * ll - langid.OVERLAP * np.log(len(p) + 1) * len(held) - 2 * np.log(1 / langid.UNKNOWN) * (last in held)

        scores = {frozenset(s): score(s) for k in range(1, last + 2) for s in combinations(range(last + 1), k)}
        chosen = frozenset(langid.Model.choose(p)[0])
        assert scores[chosen] >= max(scores.values()) - 0.05
