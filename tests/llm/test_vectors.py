from __future__ import annotations

import numpy as np

from groundcheck.llm import vectors


def near(spark, x, **how):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    return vectors.near_copies(df, **how).collect()


def check(rows, x, least: float) -> None:
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= vectors.THRESHOLD, 1))
    of = {r["vec_id"]: r["kept_id"] for r in rows}
    assert len(rows) == len(of) == len(x)
    assert np.mean([of[a] == of[b] for a, b in zip(i.tolist(), j.tolist())]) >= least
    linked = set(i.tolist()) | set(j.tolist())
    assert all(d == k or d in linked and k in linked and k < d for d, k in of.items())
    sizes = {k: sum(v == k for v in of.values()) for k in of.values()}
    assert all(r["group_size"] == sizes[r["kept_id"]] for r in rows)


def planted(spark, small) -> np.ndarray:
    x = np.stack(spark.read.parquet(f"{small}/embeddings.parquet").toPandas()["embedding"])
    rng = np.random.default_rng(0)
    return np.concatenate([x, *[x[rng.integers(0, len(x), 150)] + rng.normal(0, s, (150, 64)) / 8 for s in (0, 0.1, 0.2, 0.3)]]).astype(np.float32)


def test_recall_against_brute_force(spark, small):
    x = planted(spark, small)
    check(near(spark, x), x, 0.98)


def test_recall_over_many_cells_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 64))
    x = (centres[rng.integers(0, 12, 1500)] + rng.normal(0, 0.8, (1500, 64))).astype(np.float32)
    x = np.concatenate([x, x[:900] + rng.normal(0, 0.25, (900, 64)) * np.linalg.norm(x[:900], axis=1, keepdims=True) / 8, np.tile(x[:1], (300, 1))]).astype(np.float32)
    monkeypatch.setattr(vectors, "CELL", 30)
    check(near(spark, x, block=64), x, 0.98)


def test_odd_rows(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e), (1, e), (2, [2.0, 0.0, 0.0]), (3, e), (None, e), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [None, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, "c", "g", "v") for r in rows], "vec_id bigint, embedding array<double>, cell string, guest string, v string")
    assert sorted(tuple(r) for r in vectors.near_copies(df).collect()) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (9, 9, 1)]
    assert vectors.near_copies(df.where("false")).collect() == []
    assert [tuple(r) for r in vectors.near_copies(df.where("vec_id = 9")).collect()] == [(9, 9, 1)]


def test_labels_are_components():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 60, (2, 40))
    label = vectors._labels(60, i, j)
    assert (label[i] == label[j]).all() and all(label[k] <= k for k in range(60))
    root = {int(l) for l in label}
    reach = np.eye(60, dtype=bool)
    reach[i, j] = reach[j, i] = True
    for _ in range(7):
        reach = reach @ reach
    assert len(root) == len({tuple(r) for r in reach.tolist()})
