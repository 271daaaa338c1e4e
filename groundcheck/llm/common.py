"""Helpers shared by the operators: tables, batches, materialisation, joins with hot keys, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that are Python objects at one time.
SLICE = 1000
#: A key is hot when more than one row in this many has it, so there are fewer hot keys than this.
HOT = 1000
#: Rows of keys that are sent to every executor, so that the texts that they are joined to stay where they are.
CARRIED = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, but what it freed goes back to the system at its end: Python workers stay, and would keep it for good."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return lean_run


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = SLICE) -> DataFrame:
    """``df.mapInPandas(run, schema)``, but whatever the session's batches hold, few rows at a time become Python objects."""
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(piece.to_pandas() for piece in slices(batches, rows)):
            yield pa.RecordBatch.from_pandas(pdf, schema=shape, preserve_index=False)

    return df.mapInArrow(lean(arrow), schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a
    temporary folder, and a cluster an error: its machines share none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        own = tempfile.mkdtemp(prefix="groundcheck-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir(f"file://{own}")
    return os.path.dirname(sc.getCheckpointDir())


_WRITTEN: list[str] = []


def _drop(paths: list[str]) -> None:
    for path in paths:
        with contextlib.suppress(OSError, ValueError):  # gone already, or a file system that only Spark can reach
            fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            fs.delete_dir(at)
        with contextlib.suppress(ValueError):
            _WRITTEN.remove(path)


def drop_cuts() -> None:
    """Delete every table of ``cut`` that this driver wrote and that is still there; at the driver's end at the latest."""
    _drop(list(_WRITTEN))


atexit.register(drop_cuts)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """``cut(make())``; the tables that ``make`` wrote on the way are deleted."""
    before = set(_WRITTEN)
    out = cut(make())
    _drop([p for p in _WRITTEN[:-1] if p not in before])
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends at files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def carried(keys: DataFrame) -> DataFrame:
    """``keys``, a written table, for a join to rows with texts: broadcast up to ``CARRIED`` rows, sorted and merged beyond."""
    return F.broadcast(keys) if keys.count() <= CARRIED else keys.hint("merge")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: Column, total: int | Column, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, whose rows are unique by ``on`` and say in ``n`` how many rows of ``left`` have their key.

    Keys with more than a ``HOT``-th of ``total`` rows, of which there are fewer than ``HOT``, are broadcast, so their
    rows stay where they are; the others are shuffled. ``left`` is read twice, so it should be a written table.
    """
    key = [F.col(f"_k{i}") for i in range(len(on))]
    named = lambda d: d.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[c for c in d.columns if c not in on])
    same = [left[c] == k for c, k in zip(on, key)]
    hot = F.broadcast(named(right.where(n * HOT > total)))
    cold = named(right.where(n * HOT <= total))
    drop = [f"_k{i}" for i in range(len(on))]
    among = left.join(hot, same, "inner").drop(*drop)
    rest = left.join(hot, same, "left_anti").join(cold, same, how).drop(*drop)
    return among.unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph, as rows (node, root) with root the least node of the component.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a groupBy over the edges, so that no
    task holds a component. Self-loops are dropped and a node that has no other edge is absent from the result.
    """
    star = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while True:
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        after = cut(small)
        # a fixed point is a forest of stars: no node is both a root and a leaf, and each leaf has one root
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        open_ = leaves.where("n > 1").limit(1).count() + after.join(
            after.select(F.col("v").alias("u")).distinct(), "u", "left_semi"
        ).limit(1).count()
        star = after
        if not open_:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
