from __future__ import annotations

import random

import numpy as np

from groundcheck.llm import simhash


def groups(prints: dict[int, tuple[int, int]]) -> dict[int, int]:
    """Least member of each document's component, by all pairs."""
    root = {d: d for d in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if (prints[x][0] ^ prints[y][0]).bit_count() + (prints[x][1] ^ prints[y][1]).bit_count() <= simhash.RADIUS:
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {d: find(d) for d in ids}


def test_every_pair_within_the_radius_meets():
    rng = random.Random(3)
    for _ in range(4000):
        diff = sum(1 << i for i in rng.sample(range(simhash.PART), simhash.INNER))
        assert any(diff & m == 0 for m in simhash.MASKS)
    assert len(simhash.MASKS) == 127 and min(m.bit_count() for m in simhash.MASKS) >= 16


def test_bucket_edges_connect_what_all_pairs_connect():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**48, (30, 2))
    rows = []
    for a, b in base:
        for _ in range(rng.integers(1, 25)):
            flip = lambda: int(sum(1 << int(i) for i in rng.choice(48, rng.integers(0, 5), False)))
            rows.append((int(a) ^ flip(), int(b) ^ flip()))
    rows = sorted(set(rows))
    a, b = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    t = np.repeat(np.arange(254, dtype=np.int32), len(rows))
    pairs = simhash._bucket_edges(t, np.tile(a, 254), np.tile(b, 254)) % len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs.T:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    assert {d: find(d) for d in range(len(rows))} == groups(dict(enumerate(rows)))


def test_table_equals_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    prints = {r["doc_id"]: f for r in docs.collect() if (f := simhash.fingerprint(r["text"]))}
    want = {d: k for d, k in groups(prints).items() if d != k}
    got = {r["doc_id"]: r["kept_id"] for r in simhash.near_copies(docs).collect()}
    assert got == want and got


def test_edited_copies_are_found_and_others_left(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    texts = {}
    for i in range(120):
        words = [word() for _ in range(rng.randrange(80, 400))]
        texts[i] = " ".join(words)
        if i < 60:
            texts[1000 + i] = " ".join(word() if rng.random() < 0.03 else w for w in words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept_id"] for r in simhash.near_copies(docs).collect()}
    assert sum(got.get(1000 + i) == i for i in range(60)) >= 54
    assert all(k + 1000 == d for d, k in got.items())


def test_odd_rows(spark, odd, none):
    gone = sorted((r["doc_id"], r["kept_id"], int(r["group_size"])) for r in simhash.near_copies(odd).collect())
    assert gone == [(7, 6, 2), (8, 1, 3)]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "5", "6", "9", "None", "None"])
    assert simhash.near_copies(none).collect() == [] and simhash.keep_one(none).collect() == []


def test_case_and_marks_do_not_matter():
    assert simhash.fingerprint("The house, the HILL!") == simhash.fingerprint("hill house the")
    assert simhash.fingerprint(None) is simhash.fingerprint("") is simhash.fingerprint("?! ") is None


def test_components(spark):
    from groundcheck.llm.common import components

    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 7), (5, 5), (3, 140)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "x bigint, y bigint"), "x", "y").collect()}
    assert got == {**{i: 3 for i in range(100, 141)}, 9: 7}


def test_no_text_goes_without_a_copy_that_stays(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    x, y, z = (" ".join(word() for _ in range(120)) for _ in range(3))
    rows = [(1, x), (2, x), (2, y), (3, y), (4, z), (4, x), (4, z)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, simhash.keep_one(docs).collect())) == sorted([(1, x), (2, y), (4, z), (4, z)])
    gone = {(r["doc_id"], r["text_hash"]): (r["kept_id"], r["kept_hash"], int(r["group_size"])) for r in simhash.near_copies(docs).collect()}
    h = {t: simhash_hash(spark, t) for t in (x, y)}
    assert gone == {(2, h[x]): (1, h[x], 3), (4, h[x]): (1, h[x], 3), (3, h[y]): (2, h[y], 2)}


def simhash_hash(spark, text: str) -> str:
    from pyspark.sql import functions as F

    return spark.createDataFrame([(text,)], "t string").select(F.lpad(F.hex(F.xxhash64("t")), 16, "0")).first()[0]


def test_clashing_ids_against_brute_force(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    bases = [[word() for _ in range(100)] for _ in range(12)]
    rows = []
    for _ in range(150):
        base = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(100)] = word()
        rows.append((rng.randrange(40), " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    prints = {t: simhash.fingerprint(t) for _, t in rows}
    texts = sorted(prints)
    root = groups({i: prints[t] for i, t in enumerate(texts)})
    member = {t: root[i] for i, t in enumerate(texts)}
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(member[t] for t in {t for _, t in kept}) == sorted(set(root.values()))
    for d, t in kept:
        assert d == min(i for i, u in rows if member[u] == member[t])
    size = {g: sum(member[t] == g for _, t in rows) for g in set(root.values())}
    for r in simhash.near_copies(docs).collect():
        assert int(r["group_size"]) in {size[member[t]] for d, t in rows if d == r["doc_id"]}


def test_slots_and_batches_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda load: {(r["a"], r["b"], r["kept_id"]) for r in simhash.groups(docs, load)[1].collect()}
    assert rows(simhash.LOAD) == rows(24)


def test_routes_hold_both_their_tables_whole(spark):
    assert sorted(k for i, j, _ in simhash.ROUTES for k in {i, j}) == list(range(len(simhash.MASKS))) and len(simhash.ROUTES) == 64
    assert all(m & ~simhash.MASKS[i] == 0 and m & ~simhash.MASKS[j] == 0 and m.bit_count() >= 8 for i, j, m in simhash.ROUTES)
    nodes = spark.createDataFrame([(i * 977, i * 3_000_017) for i in range(50)], "a bigint, b bigint")
    assert simhash._placed(nodes, simhash.LOAD).count() == 50 * 128


def test_texts_stay_where_few_keys_are_joined_to_them(spark, monkeypatch):
    from groundcheck.llm import common, mixing

    rows = [(i, f"{'a b c d e f g h ' * 3} w{i // 2}", f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plans, results = [], []
        for most in (common.CARRIED, -1):
            monkeypatch.setattr(common, "CARRIED", most)
            for out in (simhash.keep_one(docs), mixing.repeated(docs)):
                plans.append(out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString())
                results.append(sorted(map(tuple, out.collect())))
        assert ["SortMergeJoin" in p for p in plans] == [False, False, True, True] and results[:2] == results[2:]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
