"""The audit of many answers: five stages over tables, each resumable.

A workspace is a folder with one Parquet table a name; tables only grow, so a crash loses none of their rows. External
calls (fetch, judge) run between two tables, and what is to be called is always what an anti-join finds missing, so a stage
that is run again repeats no call that has a row.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters, logs, schemas
from .config import Settings
from .errors import ConfigurationError, LLMProviderError
from .functions import text as T
from .operators import claims as claims_op
from .operators import fetching, judging, passages, references, reporting, retrieval, vectors
from .sources import convert

log = logging.getLogger("groundcheck.pipeline")
STAGES = tuple("extraction ingestion indexing judging reporting".split())


class Workspace:
    """Tables in a folder that all executors can reach."""

    SCHEMAS = {
        "answers": schemas.ANSWERS, "references": schemas.REFERENCES, "documents": schemas.DOCUMENTS, "claims": schemas.CLAIMS, "passages": schemas.PASSAGES,
        "curated": schemas.CURATED, "results": schemas.RESULTS, "skipped": schemas.SKIPPED, "judge_errors": schemas.JUDGE_ERRORS,
        "reference_status": schemas.REFERENCE_STATUS, "fetch_attempts": schemas.FETCH_ATTEMPTS, "runs": schemas.RUNS, "run_stages": schemas.RUN_STAGES, "pdf_links": "answer_id string, url string",
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None if schema is None else self.spark.createDataFrame([], schema)
            raise

    def report(self, run_id: str) -> str | None:
        """A run's Markdown report, where there is one."""
        held = self._table("report_md")
        row = held.where(F.col("run_id") == run_id).first() if held is not None else None
        return row["markdown"] if row else None

    def read(self, name: str) -> DataFrame:
        """A table as it is now; references carry the last status that was noted."""
        if name == "references":
            return fetching.latest_status(self._table(name, self.SCHEMAS[name]), self._table("reference_status", schemas.REFERENCE_STATUS))
        return self._table(name, self.SCHEMAS[name])

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        want = self.spark.createDataFrame([], self.SCHEMAS[name]).schema
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])

    def append(self, name: str, df: DataFrame) -> None:
        self._shaped(name, df).write.mode("append").parquet(f"{self.root}/{name}")

    def publish(self, name: str, df: DataFrame, form: str = "parquet") -> None:
        """Write rows by run: those of other runs stay, and a run's are put in place when all are written."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").format(form).save(f"{self.root}/{name}")

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written beside the tables and read again: what comes from outside is asked for once."""
        path = f"{self.root}/.{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def views(self) -> None:
        """Every table as a temporary view, for SQL."""
        for name in self.SCHEMAS:
            self.read(name).createOrReplaceTempView(name)


@dataclass
class Audit:
    """Stages with their adapters; ``get`` fetches, ``judge`` replies, ``embedder`` embeds. ``only`` names the one run to
    work on; without it all runs of the workspace are."""

    space: Workspace
    get: fetching.Get
    judge: judging.Judge = field(default_factory=judging.ContainmentJudge)
    embedder: vectors.Embedder = field(default_factory=vectors.HashEmbedder)
    settings: Settings = field(default_factory=Settings)
    pdf: Callable[[bytes], str] = adapters.pdf_markdown
    model: references.ReferenceModel | None = None
    reranker: Callable | None = None
    max_tokens: int = passages.MAX_TOKENS
    overlap: int = passages.OVERLAP
    count: passages.Count = passages.word_tokens
    retry_failed: bool = False
    only: str | None = None

    def _mine(self, name: str, column: str = "answer_id") -> DataFrame:
        rows = self.space.read(name)
        return rows if self.only is None else rows.where(F.col(column) == self.only)

    def extraction(self) -> None:
        s = self.space
        new = self._mine("answers").join(s.read("claims").select("answer_id").distinct(), "answer_id", "left_anti")
        links = s.read("pdf_links")
        refs = references.extract(new, links, self.model)
        s.append("references", refs)
        s.append("claims", claims_op.claims(new, s.read("references")))

    def ingestion(self) -> None:
        """Fetch what has no document and no attempt yet (with ``retry_failed``, what failed too); convert what came.

        A page whose conversion fails gets one attempt in the browser. Attempts and conversions are written before they
        are read, so none is made twice.
        """
        s = self.space
        held = s.read("documents")
        todo = fetching.pending(self._mine("references"), held)
        if not self.retry_failed:
            todo = todo.join(s.read("fetch_attempts").select(F.col("reference_id").alias("id")), "id", "left_anti")
        todo = s.keep("todo", todo.select("id", "raw_url"))
        s.append("fetch_attempts", fetching.fetch(todo, self.get, self.settings.fetch_partitions))
        # whatever was tried and has neither a document nor a status since is concluded here, so a crash before this line loses nothing
        seen = s.read("reference_status").select(F.col("id").alias("reference_id"))
        due = todo.select(F.col("id").alias("reference_id")).union(self._mine("references").select(F.col("id").alias("reference_id")).join(seen, "reference_id", "left_anti")).distinct()
        attempts = s.read("fetch_attempts").join(due, "reference_id", "left_semi")
        outcomes = s.keep("outcomes", fetching.outcome(attempts))
        good = outcomes.where("status = 'downloaded'")
        rank = F.array_position(F.array(*[F.lit(x) for x in ("variation", "plain", "guarded", "browser")]), F.col("strategy"))
        last = F.max_by(F.struct("url", "content", "content_type", "strategy"), F.struct(rank, "attempt"))
        body = attempts.where("http_status < 400").groupBy("reference_id").agg(last.alias("b")).select("reference_id", "b.*")
        fresh = body.join(good.select("reference_id"), "reference_id", "left_semi").join(held.select("reference_id"), "reference_id", "left_anti")
        made = s.keep("converted", convert.convert(fresh, self.pdf))
        empty = fresh.join(made.where("markdown IS NULL").select("reference_id"), "reference_id", "left_semi")
        seen = empty.where((F.col("strategy") != "browser") & ~T.is_pdf(F.coalesce("content_type", F.lit("")), F.col("url")))
        second = s.keep("refetched", fetching.refetch(seen, self.get, self.settings.fetch_partitions))
        remade = s.keep("reconverted", convert.convert(second.where("http_status < 400"), self.pdf))
        by_browser = remade.select("reference_id", F.lit("playwright").alias("fetch_method"))
        s.append("documents", convert.documents(made, good).unionByName(convert.documents(remade, by_browser)))
        s.append("fetch_attempts", second)
        broken = made.where("markdown IS NULL").join(remade.where("markdown IS NOT NULL").select("reference_id"), "reference_id", "left_anti")
        broken = broken.select("reference_id", F.lit("error").alias("status"), F.lit(None).cast("int").alias("http_status"), F.col("error").alias("error_message"))
        names = ["reference_id", "status", "http_status", "error_message"]
        all_ = outcomes.select(names).join(broken.select("reference_id"), "reference_id", "left_anti").unionByName(broken.select(names))
        held = due.join(s.read("documents").select("reference_id"), "reference_id", "left_semi").join(all_, "reference_id", "left_anti")
        all_ = all_.unionByName(held.select("reference_id", F.lit("downloaded").alias("status")), allowMissingColumns=True)
        turn = s.read("reference_status").agg(F.coalesce(F.max("turn") + 1, F.lit(0))).first()[0]
        s.append("reference_status", all_.select(F.col("reference_id").alias("id"), F.lit(turn).alias("turn"), "status", "http_status", F.current_timestamp().alias("fetched_at"), "error_message"))

    def indexing(self) -> None:
        s = self.space
        known = s.read("passages")
        start = known.agg(F.coalesce(F.max("embedding_id") + 1, F.lit(0))).first()[0]
        fresh = s.read("documents").join(known.select("reference_id").distinct(), "reference_id", "left_anti")
        chunks = s.keep("chunked", passages.chunk(fresh, self.max_tokens, self.overlap, self.count))
        rows = passages.with_ids(passages.with_sections(chunks), start)
        s.append("passages", vectors.embed(rows, self.embedder))

    def _curate(self, rows: DataFrame, full: bool) -> DataFrame:
        rows = vectors.embed(rows, self.embedder)
        return retrieval.curate(rows, self.space.read("passages"), full_corpus=full, retrieve=self.settings.retrieval_top_k, keep=self.settings.rerank_top_k, reranker=self.reranker)

    def judging(self) -> None:
        """All pending contexts are written before the first call of the judge; then claims are judged in batches, each of
        which is written before the next is asked. A provider that fails for good ends the stage, with what it cost kept."""
        s = self.space
        todo = judging.pending(self._mine("claims"), s.read("results"), s.read("skipped"))
        have = s.read("curated").select(F.col("answer_chunk_id").alias("id"))
        bare = todo.join(have, "id", "left_anti")
        modes = s.read("runs").select(F.col("run_id").alias("answer_id"), F.coalesce("full_corpus_mode", F.lit(False)).alias("full"))
        marked = bare.join(modes, "answer_id", "left")
        s.append("curated", self._curate(marked.where("NOT coalesce(full, false)").drop("full"), False))
        if marked.where("full").limit(1).count():
            s.append("curated", self._curate(marked.where("full").drop("full"), True))
        skip, ask = judging.route(s.read("curated").join(todo.select(F.col("id").alias("answer_chunk_id")), "answer_chunk_id", "left_semi"))
        s.append("skipped", skip)
        claims = self._mine("claims")
        ask = s.keep("asked", ask)
        batches = max(1, -(-ask.count() // self.settings.judge_batch))
        turn = s.read("results").agg(F.coalesce(F.shiftright(F.max("seq"), 32) + 1, F.lit(0))).first()[0]
        for batch in range(batches):
            part = ask.where(F.pmod(F.xxhash64("answer_chunk_id"), F.lit(batches)) == batch)
            replies = s.keep("replies", judging.ask(claims, part, self.judge))
            results, errors = judging.settled(replies, self.judge, self.settings.prices())
            # in the order of claims within this pass, and after all that was judged before
            place = claims.select(F.col("id").alias("answer_chunk_id"), (F.col("position") + F.lit(turn * 2**32)).alias("seq"))
            s.append("results", results.join(place, "answer_chunk_id"))
            s.append("judge_errors", errors)
            down = errors.where("error = 'provider'").first()
            if down:
                raise LLMProviderError(f"{self.judge.provider} failed: {down['raw']}")

    def report(self) -> DataFrame:
        s = self.space
        now = F.current_timestamp()
        runs = self._mine("runs", "run_id").withColumns({"generated_at": now, "processing_time_seconds": (now.cast("double") - F.col("started_at").cast("double"))})
        return reporting.report(runs, s.read("claims"), s.read("references"), s.read("results"), s.read("skipped"))

    def reporting(self) -> None:
        s = self.space
        rows = self.report()
        shown = reporting.examples(s.read("results"), s.read("claims"), s.read("references"))
        text = s.keep("rendered", reporting.markdown(rows, s.read("references"), shown, self.settings.judge_config(self.judge)))
        s.publish("report_md", text)
        s.publish("report_text", text, "text")
        s.publish("report_json", reporting.report_json(rows))

    def pending_count(self) -> int:
        s = self.space
        return judging.pending(self._mine("claims"), s.read("results"), s.read("skipped")).count()

    def run(self, force: bool = False) -> None:
        """All stages that have work; judging is done again as long as claims are pending."""
        s = self.space
        done = {r["stage"] for r in self._mine("run_stages", "run_id").select("stage").distinct().collect()}
        for number, stage in enumerate(STAGES, 1):
            if stage in done and not force and stage in ("extraction", "ingestion", "indexing") and not self._work(stage):
                log.info("%s is complete", stage)
                continue
            log.info(logs.banner(stage, number, len(STAGES)))
            began = time.monotonic()
            getattr(self, stage)()
            runs = self._mine("runs", "run_id").select("run_id", F.lit(stage).alias("stage"), F.current_timestamp().alias("completed_at"), F.lit(time.monotonic() - began).alias("seconds"))
            s.append("run_stages", runs)

    def _work(self, stage: str) -> bool:
        s = self.space
        if stage == "extraction":
            left = self._mine("answers").join(s.read("claims").select("answer_id"), "answer_id", "left_anti")
        elif stage == "ingestion":
            left = self._mine("references").where("status = 'pending'")
        else:
            left = s.read("documents").join(s.read("passages").select("reference_id"), "reference_id", "left_anti")
        return left.limit(1).count() > 0


def start(space: Workspace, answers: DataFrame, full_corpus: bool = False, links: DataFrame | None = None) -> None:
    """Register answers and a run for each, with the links (answer_id, url) of their files; a known run is left alone."""
    new = answers.join(space.read("runs").select(F.col("run_id").alias("answer_id")), "answer_id", "left_anti")
    path = F.col("path") if "path" in answers.columns else F.lit(None).cast("string")
    space.append("runs", new.select(F.col("answer_id").alias("run_id"), path.alias("answer_path"), "tool_name", F.lit(full_corpus).alias("full_corpus_mode"), F.current_timestamp().alias("started_at")))
    if links is not None:
        space.append("pdf_links", links.join(space.read("pdf_links").select("answer_id").distinct(), "answer_id", "left_anti"))
    known = space.read("answers").select("answer_id")
    space.append("answers", answers.join(known, "answer_id", "left_anti"))


def load_run(space: Workspace, run_id: str) -> dict:
    row = space.read("runs").where(F.col("run_id") == run_id).withColumn("full_corpus_mode", F.coalesce("full_corpus_mode", F.lit(False))).first()
    if row is None:
        raise ConfigurationError(f"unknown run {run_id!r}")
    return row.asDict()
