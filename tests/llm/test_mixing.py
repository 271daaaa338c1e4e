from __future__ import annotations

import numpy as np
import pytest

from groundcheck.llm import mixing


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        tokens, p = rng.integers(0, 500, n), np.full(n, 0.37)
        after = mixing.flight(p, tokens, np.random.default_rng(n))
        assert ((after > 0) & (after < 1)).sum() <= 2
        assert after.sum() == pytest.approx(p.sum()) and (after * tokens).sum() == pytest.approx((p * tokens).sum())


def test_inclusion_probabilities_hold():
    tokens = np.array([1, 5, 5, 9, 30, 2, 2, 2, 70, 4])
    p = np.array([0.3, 0.3, 0.5, 0.5, 0.2, 0.9, 0.1, 0.4, 0.3, 0.5])
    seen, count = np.zeros(10), []
    for s in range(4000):
        rng = np.random.default_rng(s)
        got = mixing.landing(mixing.flight(p, tokens, rng), rng)
        assert set(got) <= {0.0, 1.0}
        seen += got
        count.append(got.sum())
    assert np.abs(seen / 4000 - p).max() < 0.03
    assert max(count) - min(count) <= 1 or np.std(count) < 0.6


def test_ties_and_certain_units():
    after = mixing.flight(np.array([0.5] * 9 + [1.0, 0.0]), np.array([7] * 11), np.random.default_rng(0))
    assert after[9] == 1 and after[10] == 0 and after.sum() == pytest.approx(5.5) and ((after > 0) & (after < 1)).sum() <= 2


def test_targets_and_balance(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), f"s{0 if rng.random() < 0.5 else rng.integers(1, 5)}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.sampled(docs, targets={"s0": 1.0, "s1": 2.0, "s2": 1.0, "nobody": 3.0, "s4": 0.0}).toPandas()
    assert set(got["source"]) == {"s0", "s1", "s2"} and got["doc_id"].is_unique
    tokens = got.groupby("source")["tokens"].sum()
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1", "s2")}
    least = min(total["s0"] / 1, total["s1"] / 2, total["s2"] / 1)
    for s, w in (("s0", 1), ("s1", 2), ("s2", 1)):
        assert tokens[s] == pytest.approx(least * w, rel=0.02)
        n = sum(x == s for _, _, x in rows)
        assert abs((got["source"] == s).sum() - n * least * w / total[s]) <= 1
    again = mixing.sampled(docs.repartition(7), targets={"s0": 1.0, "s1": 2.0, "s2": 1.0}).toPandas()
    assert set(again["doc_id"]) == set(got["doc_id"])


def test_odd_rows(spark, odd, none):
    got = mixing.sampled(odd, targets={"s1": 1.0, "s2": 1.0}).collect()
    assert {r["source"] for r in got} <= {"s1", "s2"} and all(r["doc_id"] not in (2, 3, 4) or r["tokens"] == 0 for r in got)
    kept = mixing.mixed(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) in (0, 2)
    only = mixing.mixed(odd, targets={"s1": 1.0}).collect()
    assert sorted(str(r["doc_id"]) for r in only) == ["1", "1", "2", "None"]
    assert mixing.sampled(none).collect() == [] and mixing.mixed(none).collect() == []


def test_null_source_is_a_source(spark):
    docs = spark.createDataFrame([(i, "a b c", None if i % 2 else "x") for i in range(40)], "doc_id bigint, text string, source string")
    got = mixing.sampled(docs).toPandas()
    assert len(got) == 40
    assert len(mixing.sampled(docs, share=0.5).toPandas()) == 20


def test_hot_and_one_document_sources_do_not_set_the_size(spark, tmp_path):
    from groundcheck.llm import queries

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 2 else f"s{i % 20}") for i in range(8000)]
    rows += [(8000, "only one document", "one"), (8001, "and one", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_source_mixing(spark, str(tmp_path)).toPandas()
    held = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    assert got["tokens"].sum() == pytest.approx(mixing.TOTAL * sum(held.values()), rel=0.01)
    kept = got.groupby("source", dropna=False)["tokens"].sum()
    assert all(kept[s] == n for s, n in held.items() if s not in ("hot", None)) and kept[kept.index.isna()].iloc[0] == 2
    assert kept["hot"] == pytest.approx(held["hot"] - (1 - mixing.TOTAL) * sum(held.values()), rel=0.01)


def test_level_of_a_total(spark):
    tokens = {"a": 10, "b": 100, "c": 400, "d": 400}
    held = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(tokens.items())], "doc_id bigint, source string, tokens bigint")
    for targets in (None, {"a": 1.0, "b": 1.0, "c": 2.0, "d": 1.0}):
        for total in (0.02, 0.3, 0.7, 1.0):
            prob = {r["source"]: r["prob"] for r in mixing.plan(held, targets, 1.0, total).collect()}
            assert sum(prob[s] * n for s, n in tokens.items()) == pytest.approx(total * 910)
            level = {s: prob[s] * n / (targets or {}).get(s, 1.0) for s, n in tokens.items() if prob[s] < 1}
            assert not level or max(level.values()) == pytest.approx(min(level.values()))
            assert all(n / (targets or {}).get(s, 1.0) <= max(level.values(), default=n * 9) + 1e-6 for s, n in tokens.items() if prob[s] == 1)


def naive_flight(prob, tokens, draws) -> np.ndarray:
    """The flight with the null space of the constraint matrix itself, over the first three fractional units at a time."""
    p = [float(x) for x in prob]
    while True:
        live = [i for i, x in enumerate(p) if mixing.EPS < x < 1 - mixing.EPS][:3]
        if len(live) < 3:
            return np.array(p)
        u = np.linalg.svd(np.array([[1.0] * 3, [float(tokens[k]) for k in live]]))[2][-1]
        if len({tokens[k] for k in live}) == 1:
            u = np.array([1.0, -1.0, 0.0])
        want = [tokens[live[2]] - tokens[live[1]], tokens[live[0]] - tokens[live[2]], tokens[live[1]] - tokens[live[0]]]
        if float(np.dot(u, want)) < 0:
            u = -u
        steps = [s for x, d in zip((p[k] for k in live), u) if abs(d) > 1e-12 for s in ((1 - x) / d, -x / d)]
        up, down = min(s for s in steps if s >= 0), -max(s for s in steps if s <= 0)
        move = up if next(draws) * (up + down) < down else -down
        for k, d in zip(live, u):
            p[k] = min(1.0, max(0.0, p[k] + move * d))
            p[k] = 0.0 if p[k] < 1e-7 else 1.0 if p[k] > 1 - 1e-7 else p[k]


def test_flight_against_the_null_space():
    rng = np.random.default_rng(11)
    for case in range(60):
        n = int(rng.integers(0, 40))
        tokens, p = rng.integers(0, 9 if case % 2 else 400, n), rng.random(n)
        draws = np.random.default_rng(case).random(n + 8).tolist()
        assert mixing.flight(p, tokens, np.random.default_rng(case)) == pytest.approx(naive_flight(p, tokens, iter(draws)), abs=1e-5)


def test_sample_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect())
    totals = {s: sum(t for _, x, t in rows if x == s) for s in {s for _, s, _ in rows}}
    lo, hi = 0.0, float(max(totals.values()))
    for _ in range(100):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(t, level) for t in totals.values()) < mixing.TOTAL * sum(totals.values()) else (lo, level)
    want = set()
    for source, all_ in totals.items():
        own = [(d, t) for d, s, t in rows if s == source]
        p, tokens = np.full(len(own), min(1.0, hi / all_)), [t for _, t in own]
        draws = lambda *what: iter(mixing._rng(7, *what).random(len(own) + 8).tolist())
        p = naive_flight(p, tokens, draws("bucket", source, 0))
        left = [i for i, x in enumerate(p) if 0 < x < 1]
        after = naive_flight(p[left], [tokens[i] for i in left], draws("source", source))
        p[left] = mixing.landing(after, mixing._rng(7, "land", source))
        want |= {own[i][0] for i in np.flatnonzero(p == 1)}
    got = {r["doc_id"] for r in mixing.sampled(docs, total=mixing.TOTAL).collect()}
    assert got == want


def test_parts_and_rows_without_an_id(spark):
    rows = [(None, f"text {i} of many words", "hot") for i in range(200)] + [(1, "a b", "x"), (1, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for how in ({"share": 2.0}, {"share": -0.1}, {"total": 1.5}):
        with pytest.raises(ValueError):
            mixing.sampled(docs, **how)
        with pytest.raises(ValueError):
            mixing.mixed(docs, **how)
    kept = mixing.mixed(docs, targets={"hot": 1.0}, share=0.5).collect()
    assert len(kept) == 100 and len({r["text"] for r in kept}) == 100


def brute_copies(rows: list[tuple]) -> dict[int, int]:
    """Copies of each document of (doc_id, source, tokens) where all sources are to have the tokens of the longest."""
    totals = {s: sum(t for _, x, t in rows if x == s) for s in {s for _, s, _ in rows}}
    want = {}
    for source, all_ in totals.items():
        own = sorted((d, t) for d, s, t in rows if s == source)
        least, part = divmod(max(totals.values()), all_) if all_ else (1, 0)
        if part:
            p, tokens = np.full(len(own), max(totals.values()) / all_ - least), [t for _, t in own]
            draws = lambda *what: iter(mixing._rng(7, *what).random(len(own) + 8).tolist())
            p = naive_flight(p, tokens, draws("bucket", source, 0))
            left = [i for i, x in enumerate(p) if 0 < x < 1]
            p[left] = mixing.landing(naive_flight(p[left], [tokens[i] for i in left], draws("source", source)), mixing._rng(7, "land", source))
        want |= {d: least + (int(p[i]) if part else 0) for i, (d, _) in enumerate(own)}
    return want


def test_query_gives_every_document_and_every_source_its_target(spark, small):
    from groundcheck.llm import queries

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    got = queries.op7_source_mixing(spark, str(small)).toPandas()
    assert dict(zip(got["doc_id"], got["copies"])) == brute_copies(rows) and len(got) == len(rows)
    most = max(sum(t for _, x, t in rows if x == s) for s in {s for _, s, _ in rows})
    longest = max(t for _, _, t in rows)
    assert all(abs(n - most) <= longest for n in (got["tokens"] * got["copies"]).groupby(got["source"]).sum())


def test_copies_of_hot_short_and_empty_sources(spark, odd, none):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), "hot" if i % 2 else f"s{i % 20}") for i in range(8000)]
    rows += [(8000, "only one document", "one"), (8001, "and one", None), (8002, "", "empty"), (8003, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.weighted(docs).toPandas()
    assert sorted(got["doc_id"]) == [r[0] for r in rows] and got["copies"].min() == 1
    held = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    mix = (got["tokens"] * got["copies"]).groupby(got["source"].fillna("null")).sum()
    assert mix.pop("empty") == 0 and all(abs(n - held["hot"]) <= 60 for n in mix)
    assert set(got["copies"][got["source"].isin(["hot", "empty"])]) == {1}
    double = mixing.weighted(docs, targets={"hot": 1.0, "s0": 2.0, "gone": 1.0, "s2": 0.0}).toPandas()
    mix = (double["tokens"] * double["copies"]).groupby(double["source"]).sum()
    assert set(mix.index) == {"hot", "s0"} and abs(mix["s0"] - 2 * mix["hot"]) <= 60
    some = docs.where("doc_id < 400 OR doc_id >= 8000")
    copies = {r["doc_id"]: r["copies"] for r in mixing.weighted(some).collect()}
    times = {r["doc_id"]: r["count"] for r in mixing.repeated(some).groupBy("doc_id").count().collect()}
    assert times == copies and max(copies.values()) > mixing.CHUNK
    out = mixing.repeated(odd)
    assert out.columns == odd.columns and out.schema == odd.schema and out.distinct().count() == odd.distinct().count()
    assert mixing.weighted(none).collect() == [] and mixing.repeated(none).collect() == []


def test_sample_of_a_part_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "TOTAL", 0.95)
    test_sample_against_brute_force(spark, small)
