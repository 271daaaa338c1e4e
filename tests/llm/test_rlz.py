from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from groundcheck.llm import rlz
from tests.llm.conftest import LONG


def brute(texts: dict[int, str]) -> dict[int, set[int]]:
    """Words in windows whose first occurrence is in another document."""
    first: dict[tuple, int] = {}
    out: dict[int, set[int]] = {}
    for d in sorted(texts):
        words = texts[d].split()
        for i in range(len(words) - rlz.MIN_WORDS + 1):
            owner = first.setdefault(tuple(words[i : i + rlz.MIN_WORDS]), d)
            if owner != d:
                out.setdefault(d, set()).update(range(i, i + rlz.MIN_WORDS))
    return out


def covered(rows) -> dict[int, set[int]]:
    out: dict[int, set[int]] = {}
    for r in rows:
        assert not out.get(r["doc_id"], set()) & set(range(r["start"], r["stop"]))
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    return out


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = rlz.factors(docs).collect()
    assert covered(rows) == brute(texts) and rows
    for r in rows:
        ours, theirs = texts[r["doc_id"]].split(), texts[r["source_id"]].split()
        assert r["source_id"] < r["doc_id"] and r["stop"] - r["start"] >= rlz.MIN_WORDS
        shared = {tuple(theirs[i : i + 50]) for i in range(len(theirs) - 49)}
        assert any(tuple(ours[i : i + 50]) in shared for i in range(r["start"], r["stop"] - 49))


def test_planted_passages(spark):
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(50, 90))] for _ in range(6)]
    texts = {}
    for d in range(60):
        words = [word() for _ in range(rng.randrange(0, 200))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[:49] if rng.random() < 0.2 else p
        texts[d] = "\n".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = covered(rlz.factors(docs).collect())
    assert got == brute(texts) and got
    left = {r["doc_id"]: r["text"] for r in rlz.without_repeats(docs).collect()}
    for d, text in texts.items():
        want = [w for i, w in enumerate(text.split()) if i not in got.get(d, ())]
        assert left.get(d, "").split() == want


def test_odd_rows(spark, odd, none):
    rows = rlz.factors(odd).collect()
    assert [(r["doc_id"], r["start"], r["stop"], r["source_id"], r["factors"]) for r in rows] == [(7, 0, 30_000, 6, 1)]
    out = rlz.without_repeats(odd)
    assert out.columns == odd.columns
    kept = out.collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "1", "2", "3", "4", "5", "6", "8", "9", "None", "None"])
    assert next(r["text"] for r in kept if r["doc_id"] == 6) == LONG and next(r["text"] for r in kept if r["doc_id"] == 4) == " \n\t "
    assert rlz.factors(none).collect() == [] and rlz.without_repeats(none).collect() == []


def test_repeats_within_a_document_and_repeated_rows_stay(spark):
    p = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{p} {p}"), (1, f"{p} {p}"), (2, f"x {p} y"), (2, f"x {p} y")], "doc_id bigint, text string")
    assert [(r["doc_id"], r["start"], r["stop"]) for r in rlz.factors(docs).collect()] == [(2, 1, 61)]
    assert sorted(r["text"] for r in rlz.without_repeats(docs).collect()) == [f"{p} {p}"] * 2 + ["x y"] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "é", "x y", "日本"]), max_size=40), st.sampled_from([" ", "\n", " \t\n "]))
def test_words_and_window_hashes(words, gap):
    raw = gap.join(words).encode()
    starts, ends = rlz.words(raw)
    assert [raw[i:j].decode() for i, j in zip(starts, ends)] == words
    h = rlz.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == len(set(words))
    w = rlz.windows(h, 3, rlz._BASES[0][1])
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    assert len(w) == len(runs) and len(set(zip(w.tolist(), runs))) == len(set(runs)) == len(set(w.tolist()))


def test_rows_that_share_an_id_keep_their_own_words(spark):
    x, clean = " ".join(f"x{i}" for i in range(80)), " ".join(f"clean{i}" for i in range(200))
    docs = spark.createDataFrame([(1, x), (2, x), (2, clean), (2, clean)], "doc_id bigint, text string")
    assert sorted(map(tuple, rlz.without_repeats(docs).collect())) == sorted([(1, x), (2, clean), (2, clean)])
    rows = rlz.factors(docs).collect()
    assert [(r["doc_id"], r["start"], r["stop"], r["source_id"], r["source_key"]) for r in rows] == [(2, 0, 80, 1, "0" * 16)] and int(rows[0]["text_key"], 16)
    both = spark.createDataFrame([(5, x), (5, x + " end"), (5, clean)], "doc_id bigint, text string")
    left = sorted(r["text"] for r in rlz.without_repeats(both).collect())
    assert left in ([clean, "end", x], sorted([clean, x + " end"]))


def test_clashing_ids_against_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(50, 70))] for _ in range(4)]
    rows = []
    for _ in range(80):
        words = [word() for _ in range(rng.randrange(0, 100))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((rng.randrange(30), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    order = [(r["doc_id"], r["h"], r["text"]) for r in docs.select("doc_id", F.xxhash64("text").alias("h"), "text").distinct().collect()]
    want = brute({(d, h): t for d, h, t in order})
    kept = {(d, h): " ".join(w for i, w in enumerate(t.split()) if i not in want.get((d, h), ())) for d, h, t in order}
    for load, clashes in ((rlz.LOAD, rlz.CLASHES), (64, 0)):
        monkeypatch.setattr(rlz, "CLASHES", clashes)
        got = sorted((r["doc_id"], " ".join(r["text"].split())) for r in rlz.without_repeats(docs.distinct(), load).collect())
        assert got == sorted((d, kept[d, h]) for d, h, _ in order if kept[d, h] or (d, h) not in want)


def test_hot_passages_give_the_same_spans(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    hot = " ".join(f"hot{i}" for i in range(70))
    more = spark.createDataFrame([(10_000 + i, f"own{i} {hot} tail{i}", "en", "s", 1) for i in range(150)], docs.schema)
    docs = docs.union(more)
    rows = lambda load: sorted(map(tuple, rlz.factors(docs, load).collect()))
    assert rows(rlz.LOAD) == rows(256) and len(rows(256)) > 149


def naive(texts: dict[int, str]) -> dict[int, list[tuple]]:
    """Spans (start, stop, factors, sources) by comparing every document with every earlier one, word by word."""
    words = {d: t.split() for d, t in texts.items()}
    out: dict[int, list[tuple]] = {}
    for d in sorted(words):
        mine, matches = words[d], []
        for e in sorted(words):
            if e >= d:
                break
            theirs = words[e]
            for shift in range(-len(mine) + 1, len(theirs)):
                start = None
                for p in range(max(0, -shift), len(mine) + 1):
                    same = p < len(mine) and p + shift < len(theirs) and mine[p] == theirs[p + shift]
                    if same and start is None:
                        start = p
                    if not same and start is not None:
                        if p - start >= rlz.MIN_WORDS:
                            matches.append((start, -p, e, start + shift))
                        start = None
                    if p + shift >= len(theirs):
                        break
        here, spans = 0, []
        while here < len(mine):
            cover = [m for m in matches if m[0] <= here < -m[1]]
            if not cover:
                here += 1
                continue
            best = min(cover, key=lambda m: m[1:])
            part = (here, -best[1], best[2], best[3] + here - best[0])
            if spans and spans[-1][1] == here:
                spans[-1] = (spans[-1][0], part[1], [*spans[-1][2], part])
            else:
                spans.append((here, part[1], [part]))
            here = part[1]
        for start, stop, parts in spans:
            longest = max(parts, key=lambda p: (p[1] - p[0], -p[0]))
            out.setdefault(d, []).append((start, stop, longest[2], longest[3], len(parts)))
    return out


def spans_of(spark, texts: dict[int, str]) -> dict[int, list[tuple]]:
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    out: dict[int, list[tuple]] = {}
    for r in sorted(rlz.factors(docs).collect(), key=lambda r: (r["doc_id"], r["start"])):
        out.setdefault(r["doc_id"], []).append((r["start"], r["stop"], r["source_id"], r["source_start"], r["factors"]))
    return out


def test_one_factor_where_one_source_has_it_all(spark):
    part = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = part("a"), part("b"), part("c")
    texts = {1: a, 2: f"{a} {b}", 3: f"{a} {b}"}
    assert spans_of(spark, texts) == naive(texts) == {2: [(0, 60, 1, 0, 1)], 3: [(0, 120, 2, 0, 1)]}
    texts = {1: f"x {a} y", 2: f"{a} {b}", 3: f"{b} {c} z", 4: f"{a} {b} {c}", 5: f"q {a} {b} {c} r"}
    got = spans_of(spark, texts)
    assert got == naive(texts) and got[5] == [(1, 181, 4, 0, 1)]


def test_factors_against_comparing_all_words(spark):
    rng = random.Random(31)
    passages = [[f"{c}{i}" for i in range(rng.randrange(50, 75))] for c in "abcdefgh"]
    texts = {}
    for d in range(60):
        words = [f"own{d}x{i}" for i in range(rng.randrange(0, 5))]
        for p in rng.sample(passages, rng.randrange(0, 4)):
            words += p if rng.random() < 0.8 else p[: rng.randrange(20, len(p))]
            words += [f"mid{d}x{len(words)}"] * (rng.random() < 0.3)
        texts[d] = " ".join(words)
    got, want = spans_of(spark, texts), naive(texts)
    bare = lambda spans: {(d, s[0], s[1]) for d, rows in spans.items() for s in rows}
    assert bare(got) == bare(want)  # the same words are covered
    pairs = [(g, w) for d in want for g, w in zip(got[d], want[d])]
    assert all(g[4] >= w[4] for g, w in pairs) and sum(g == w for g, w in pairs) >= 0.9 * len(pairs) and len(pairs) > 40


def test_batches_do_not_matter():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = []
    for doc in range(30):
        pos = 0
        for _ in range(rng.integers(1, 5)):
            pos += int(rng.integers(0, 120))
            src, at = int(rng.integers(0, 5)), int(rng.integers(0, 1000))
            for _ in range(rng.integers(1, 80)):
                rows += [(doc // 2 + 10, doc % 2, pos, src, 0, at)] * (1 + (pos % 11 == 0))
                pos, at = pos + 1, at + 1
    whole = [np.array([r[i] for r in rows], np.int64) for i in range(6)]
    names = ["doc_id", "k", "pos", "src", "sk", "at"]
    read = lambda n: pa.Table.from_batches(
        list(rlz._runs(pa.RecordBatch.from_arrays([pa.array(x[i : i + n]) for x in whole], names) for i in range(0, len(rows), n)))
    ).to_pylist()
    assert read(len(rows)) == read(7) == read(1)
    spread = {(r["doc_id"], r["k"], r["pos"] + i, r["src"], r["sk"], r["at"] + i) for r in read(7) for i in range(r["n"])}
    assert spread == set(rows) and sum(r["n"] for r in read(7)) == len(set(rows))


def test_few_documents_with_their_sources_are_python_objects_at_once():
    import pyarrow as pa

    run = lambda at: {"pos": 0, "n": 30, "src": 0, "sk": 0, "at": at}
    rows = [{"doc_id": d, "k": 0, "runs": [run(d)], "seeds": [{"pos": 0, "src": 0, "sk": 0, "at": d}], "sources": []} for d in range(1, 401)]
    parts = list(rlz._parse(iter(pa.Table.from_pylist(rows).to_batches())))
    assert max(p.num_rows for p in parts) <= 50
    assert [(r["doc_id"], r["start"], r["stop"], r["source_start"]) for p in parts for r in p.to_pylist()] == [(d, 0, 79, d) for d in range(1, 401)]
