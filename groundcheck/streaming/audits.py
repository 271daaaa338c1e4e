"""Answers as a stream: each micro-batch is registered and audited; anti-joins make repeats of a batch harmless."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..pipeline import Audit, start
from ..schemas import ANSWERS


def answer_stream(spark, path: str) -> DataFrame:
    """New JSON-line files of answers."""
    return spark.readStream.schema(ANSWERS).json(path)


def audit_stream(answers: DataFrame, audit: Audit, checkpoint: str, full_corpus: bool = False, **trigger: object) -> StreamingQuery:
    def batch(rows: DataFrame, _: int) -> None:
        start(audit.space, rows.dropDuplicates(["answer_id"]), full_corpus)
        audit.run()

    return answers.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
