"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from groundcheck.operators import passages, reporting, vectors
from groundcheck.plans import queries as Q
from tests.test_plans import plan


def test_lines_of_a_report_search_no_map(spark, small):
    refs = Q._pages_as_refs(spark, small)
    text = reporting.markdown(Q._report(spark, small), refs)
    assert "map_from_entries" not in plan(text) and "element_at(labels" not in plan(text)
    some = refs.where("ord % 2 = 0")  # a reference without marks is shown by its URL
    lines = {line for r in reporting.markdown(Q._report(spark, small), some).collect() for line in r["markdown"].split("\n") if line.startswith("| [")}
    of = {r["id"]: r["raw_url"] for r in refs.select("id", "raw_url").distinct().collect()}
    heads = {line.split("](")[0] for line in lines}
    assert heads == {f"| [[{i}]" if int(i) % 2 == 0 else f"| [{url}" for i, url in of.items()}


def test_best_holds_a_tile_of_the_scores(monkeypatch):
    rng = np.random.default_rng(5)
    q, x = rng.integers(-2, 3, (300, 6)).astype(np.float32), rng.integers(-2, 3, (60_000, 6)).astype(np.float32)  # many ties
    ids = rng.permutation(len(x))
    tracemalloc.start()
    row, at, score = vectors._best(q, ids, x, 7)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # all scores of these queries are 144 MB
    for n in range(0, 300, 37):
        s = x.astype(float) @ q[n]
        want = np.lexsort((ids, -s))[:7]
        assert at[row == n].tolist() == want.tolist() and score[row == n].tolist() == s[want].tolist()
    monkeypatch.setattr(vectors, "TILE", (3, 2))
    few = vectors._best(q[:10], ids[:9], x[:9], 7)
    monkeypatch.undo()
    assert all((a == b).all() for a, b in zip(few, vectors._best(q[:10], ids[:9], x[:9], 7)))


def test_long_reference_is_spread(spark, small, monkeypatch):
    asked, held = Q._asked(spark, small), Q._passages(spark, small)
    rows = lambda: sorted(vectors.top_scoped(asked, held, 3).select("claim_id", "embedding_id", "score", "rank").collect())
    whole = rows()
    monkeypatch.setattr(vectors, "PASSAGES_PER_TASK", 9)
    monkeypatch.setattr(vectors, "CLAIMS_PER_TASK", 40)
    assert rows() == whole


def test_full_search_moves_a_vector_a_fixed_number_of_times(spark):
    d = spark.range(60_000).select(F.col("id").alias("claim_id"), F.col("id").alias("embedding_id"), F.array(F.lit(1.0)).alias("embedding"))
    text = vectors.top_full(d.drop("embedding_id"), d.drop("claim_id"), 1)._jdf.queryExecution().analyzed().toString()
    last = [int(n) for n in re.findall(r"explode\(sequence\(0, (\d+)", text)]
    assert len(last) == 2 and max(last) < vectors.GRID


def test_chunks_are_handed_on_before_the_batch_is_done(spark):
    batch = pa.RecordBatch.from_pydict({"reference_id": [str(i) for i in range(40)], "markdown": [None, "", *["word " * 20_000] * 38]})
    lists = passages.bounded([batch], lambda r, m: ((r, i, c, 0) for i, c in enumerate(passages.split_markdown(m))))
    sizes = [sum(len(row[2]) for row in rows) for rows in lists]
    assert len(sizes) > 3 and max(sizes) < passages.HELD + 512 * 6
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "x " * 600)], "reference_id string, markdown string")
    assert [(r[0], r[1], r[3]) for r in passages.chunk(docs, 512, 0).orderBy("position").collect()] == [("c", 0, 512), ("c", 1, 88)]
