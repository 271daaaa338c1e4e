"""``python -m groundcheck.cli run|resume|report|compare``."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import adapters, logs
from .config import Settings
from .errors import ConfigurationError, LLMProviderError
from .operators import judging, references, reporting, vectors
from .pipeline import Audit, Workspace, load_run, start
from .sources.answers import read_answers, read_pdf_links


def audit_of(space: Workspace, settings: Settings, fetcher: str | None = None, pdf: str | None = None, only: str | None = None) -> Audit:
    """All adapters as the settings name them."""
    judge = judging.client(settings)
    name = settings.embedding_model
    embedder = vectors.HashEmbedder(int(name.removeprefix("hash-"))) if name.startswith("hash-") else adapters.SentenceEmbedder(name, settings.model_cache_dir)
    more: dict = {"count": adapters.token_counter(settings.tokenizer_file)} if settings.tokenizer_file else {}
    if settings.extraction_strategy not in ("rules", "model"):
        raise ConfigurationError(f"unknown extraction strategy {settings.extraction_strategy!r}")
    if settings.extraction_strategy == "model":
        reader = judging.client(settings, schema=references.EXTRACTED_SHAPE)
        more["model"] = lambda text: reader.reply(references.EXTRACT, text)[0]
    return Audit(
        space, adapters.named(fetcher) if fetcher else adapters.http_get, judge, embedder, settings, adapters.named(pdf) if pdf else adapters.pdf_markdown,
        reranker=adapters.cross_encoder(settings.reranker_model, settings.model_cache_dir) if settings.reranker_model else None, only=only, **more,
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="groundcheck")
    parser.add_argument("--fetcher", help="module:function used in place of the HTTP clients")
    parser.add_argument("--pdf", help="module:function that turns the bytes of a PDF into Markdown")
    parser.add_argument("--strategy", choices=("rules", "model"), help="how source lists are read")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("answers", nargs="+")
    run.add_argument("--tool", default="unknown")
    run.add_argument("--full-corpus", action="store_true")
    for name in ("resume", "report"):
        commands.add_parser(name).add_argument("run_id")
    commands.add_parser("compare").add_argument("run_ids", nargs="+")
    args = parser.parse_args(argv)
    settings = Settings.load()
    if args.strategy:
        settings = dataclasses.replace(settings, extraction_strategy=args.strategy)
    logs.setup(settings.log_level, settings.log_format)
    spark = spark or SparkSession.builder.appName("groundcheck").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    space = Workspace(spark, settings.runs_dir)
    try:
        audit = audit_of(space, settings, args.fetcher, args.pdf)
        if args.command == "run":
            stamp = datetime.now(UTC)
            answers = read_answers(spark, args.answers, args.tool, audit.pdf, stamp)
            start(space, answers, args.full_corpus, read_pdf_links(spark, args.answers, stamp))
            for row in answers.select("answer_id").collect():  # a row a file on the command line
                audit.only = row["answer_id"]
                audit.run()
                print(row["answer_id"])
        elif args.command == "resume":
            load_run(space, args.run_id)
            audit.only = args.run_id
            audit.run()
            print(f"{audit.pending_count()} pending")
        elif args.command == "report":
            load_run(space, args.run_id)
            text = space.report(args.run_id)
            if text is None:
                print(f"no report yet; try: resume {args.run_id}", file=sys.stderr)
                return 1
            print(text)
        else:
            runs = [(r, load_run(space, r)["tool_name"]) for r in args.run_ids]
            of = space.read("claims").select(F.col("id").alias("answer_chunk_id"), F.col("answer_id").alias("run_id"))
            rows = space.read("results").join(of, "answer_chunk_id").withColumn("tool_name", F.lit(None).cast("string"))
            print(reporting.comparison_markdown(reporting.compare(rows, runs)))
    except ConfigurationError as error:
        print(error, file=sys.stderr)
        return 2
    except LLMProviderError as error:
        print(f"{error}; try: resume", file=sys.stderr)
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())
