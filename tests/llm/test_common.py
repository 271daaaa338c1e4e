from __future__ import annotations

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from groundcheck.llm import common


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    rows = [(1, i) for i in range(60)] + [(k, 100 + k) for k in range(2, 42)] + [(99, 7)]
    left = spark.createDataFrame(rows, "k bigint, x bigint")
    right = spark.createDataFrame([(k, f"v{k}", sum(r[0] == k for r in rows)) for k in range(1, 50)], "k bigint, v string, n bigint")
    got = common.join_hot(left, right, ["k"], F.col("n"), len(rows))
    assert got.columns == ["k", "x", "v", "n"]
    want = left.join(right, "k").select("k", "x", "v", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 100


def test_tables_of_a_stage_go_when_it_is_done(spark):
    seen = []

    def stage():
        inner = common.cut(spark.range(5).toDF("x"))
        seen.append(inner.inputFiles()[0].removeprefix("file://"))
        return inner.where("x > 1")

    out = common.settled(stage)
    assert out.count() == 3 and not os.path.exists(seen[0])


def test_a_cluster_without_a_shared_folder_is_refused():
    session = lambda at, master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("hdfs://a/b/", "yarn")) == "hdfs://a/b"
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            common.shared_dir(session(None, master))


def test_slices_leave_the_session_alone(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)

    def run(parts):
        for p in parts:
            yield p.assign(n=len(p))[["x", "n"]]

    got = common.map_slices(spark.range(0, 95, 1, 1).toDF("x"), run, "x bigint, n bigint", rows=10).collect()
    assert [r["x"] for r in got] == list(range(95)) and {r["n"] for r in got} == {10, 5}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before


def test_a_worker_keeps_little_after_a_task():
    import pyarrow as pa

    def held() -> float:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * os.sysconf("SC_PAGESIZE") / 1e6

    pins = []

    def run(batches):
        for b in batches:
            small = [bytearray(60_000) for _ in range(5000)]
            pins.append(bytearray(60_000))  # what lies above the freed memory keeps it from going back by itself
            del small
            yield b

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    list(common.lean(iter)(iter([])))
    before = held()
    assert list(common.lean(run)(iter([batch]))) == [batch]
    assert held() < before + 100
