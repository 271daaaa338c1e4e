"""Passages of fetched documents, their sections and dense ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

MAX_TOKENS, OVERLAP, RANGES = 512, 50, 256
#: Characters of passages that a task holds before it hands them on.
HELD = 1 << 20
Count = Callable[[str], int]


def word_tokens(text: str) -> int:
    return len(text.split())


def _pieces(text: str) -> Iterator[list[str]]:
    """Ever finer ways to take a text apart: sections, paragraphs, lines, sentences, words."""
    for pattern in (r"(?m)(?=^#{1,6}\s)", r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])(?=\s)", r"(?<=\s)(?=\S)"):
        yield [p for p in re.split(pattern, text) if p]


def split_markdown(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, count: Count = word_tokens) -> list[str]:
    """Chunks of at most ``max_tokens``, cut at the coarsest boundary that allows it, each repeating the end of the last.

    A single word over the limit is a chunk of its own.
    """

    def atoms(part: str) -> list[str]:
        if count(part) <= max_tokens:
            return [part]
        for pieces in _pieces(part):
            if len(pieces) > 1:
                return [a for p in pieces for a in atoms(p)]
        return [part]

    chunks: list[str] = []
    held: list[str] = []
    bound, fresh = 0, False  # parts counted apart are at least as many tokens as together
    for atom in atoms(text):
        size = count(atom)
        if held and fresh and bound + size > max_tokens and count("".join([*held, atom])) > max_tokens:
            chunks.append("".join(held).strip())
            tail: list[str] = []
            bound = 0
            while held and bound + count(held[-1]) <= min(overlap, max_tokens - size):
                bound += count(held[-1])
                tail.insert(0, held.pop())
            held = tail
        held.append(atom)
        bound, fresh = bound + size, True
    if fresh:
        chunks.append("".join(held).strip())
    return [c for c in chunks if c]


def chunk(documents: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, count: Count = word_tokens) -> DataFrame:
    """(reference_id, position, text, token_count) of all documents."""

    shape = pa.schema([("reference_id", pa.string()), ("position", pa.int32()), ("text", pa.string()), ("token_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in bounded(batches, lambda r, m: ((r, i, c, count(c)) for i, c in enumerate(split_markdown(m, max_tokens, overlap, count)))):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    return documents.select("reference_id", "markdown").mapInArrow(run, "reference_id string, position int, text string, token_count int")


def bounded(batches: Iterator[pa.RecordBatch], split: Callable[[str, str], Iterable[tuple]]) -> Iterator[list[tuple]]:
    """What ``split`` makes of each (id, text), in lists of about ``HELD`` characters of text; one text is a Python object at a time."""
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            for row in split(key.as_py(), text.as_py() or ""):
                rows.append(row)
                held += len(row[2])
                if held >= HELD:
                    yield rows
                    rows, held = [], 0
    if rows:
        yield rows


def word_windows(documents: DataFrame, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The same columns by windows of words, without Python."""
    step = size - overlap
    rows = documents.select("reference_id", T.words(F.col("markdown")).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - size) / F.lit(step)).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * step + 1, F.lit(size)))
    return rows.select("reference_id", F.posexplode_outer(windows).alias("position", "p")).where("position IS NOT NULL").select(
        "reference_id", "position", F.array_join("p", " ").alias("text"), F.size("p").alias("token_count")
    )


def with_sections(rows: DataFrame, first_line: bool = False) -> DataFrame:
    """Passages with the last header seen in their document; ``first_line`` also takes headers with text below them."""
    title = F.regexp_extract("text", r"^#{1,6}\s+([^\n]*)", 1) if first_line else T.whole_header(F.col("text"))
    order = W.partitionBy("reference_id").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.nullif(title, F.lit("")), ignorenulls=True).over(order))


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """Passages with their id and a dense number over all documents in the order of reference_id.

    Documents' counts are summed up within ranges of ids and the ranges' totals across them, so no task sorts them all. The
    ranges' bounds are ids of ``RANGES`` documents, those of least hash: they share out the work and change no number.
    """
    counts = rows.groupBy("reference_id").agg((F.max("position") + 1).cast("bigint").alias("n"))
    some = rows.select("reference_id").distinct().orderBy(F.xxhash64("reference_id"), "reference_id").limit(RANGES).collect()
    bounds = F.array(*[F.lit(r[0]) for r in some]).cast("array<string>")
    block = F.size(F.filter(bounds, lambda b: b < F.col("reference_id")))
    totals = counts.groupBy(block.alias("block")).agg(F.sum("n").alias("t"))
    upto = totals.select("block", (F.sum("t").over(W.orderBy("block")) - F.col("t")).alias("lower"))  # one row a block
    inner = W.partitionBy("block").orderBy("reference_id").rowsBetween(W.unboundedPreceding, 0)
    begins = counts.withColumn("block", block).withColumn("before", F.sum("n").over(inner) - F.col("n")).join(upto, "block")
    begins = begins.select("reference_id", (F.col("before") + F.col("lower") + start).alias("base"))
    return rows.join(begins, "reference_id").withColumns({
        "id": F.concat_ws("-", "reference_id", F.col("position").cast("string")), "embedding_id": F.col("base") + F.col("position"),
    }).drop("base")
