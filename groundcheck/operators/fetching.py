"""Fetch outcomes as a pure function of attempts, and the fetching of what is not held yet.

Attempts are rows (reference_id, url, strategy, attempt, http_status, error_kind, content, content_type); strategies are
tried in the order ``plain``, ``guarded`` (an anti-bot client), ``browser``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import FETCH_ATTEMPTS

EXTRA_TRIES, BACKOFF, DEFAULT_WAIT = 2, 2.0, 60.0
METHODS = {"plain": "requests", "guarded": "cloudscraper", "browser": "playwright"}


def outcome(attempts: DataFrame) -> DataFrame:
    """(reference_id, status, http_status, fetch_method, error_message): what the last attempts of each strategy say.

    Plain: success or 404 decides, 403 hands over to the guarded client, all else ends inaccessible. Guarded: 404 is
    dead, 403 hands over to the browser unless the URL is a PDF, other failures are inaccessible, an exception is an
    error. A dead URL with an escaped space is saved by a success at one of its variations (strategy ``variation``).
    """
    last = attempts.groupBy("reference_id").agg(
        F.max(F.when(F.col("strategy") != "variation", F.col("url"))).alias("url"),
        *[
            F.max_by(F.struct("http_status", "error_kind"), F.when(F.col("strategy") == s, F.col("attempt"))).alias(s)
            for s in ("plain", "guarded", "browser")
        ],
        F.min(F.when((F.col("strategy") == "variation") & (F.col("http_status") < 400), F.col("http_status"))).alias("saved"),
    )
    code = lambda s: F.col(f"{s}.http_status")
    ok = lambda s: code(s).isNotNull() & (code(s) < 400)
    pdf = T.is_pdf(F.lit(""), F.col("url"))
    guarded = code("plain") == 403
    by = (
        F.when(ok("plain"), "plain").when(guarded & ok("guarded"), "guarded")
        .when(guarded & (code("guarded") == 403) & ~pdf & ok("browser"), "browser")
    )
    dead = (code("plain") == 404) | (guarded & (code("guarded") == 404))
    raised = guarded & F.col("guarded.error_kind").isNotNull() & code("guarded").isNull()
    status = (
        F.when(by.isNotNull(), "downloaded").when(dead & F.col("saved").isNotNull() & F.col("url").contains("%20"), "downloaded")
        .when(dead, "dead").when(F.col("plain.error_kind") == "conversion", "error").when(raised, "error").otherwise("inaccessible")
    )
    shown = F.coalesce(F.when(by == "plain", code("plain")).when(by == "guarded", code("guarded")).when(by == "browser", F.lit(200)), "saved")
    message = F.coalesce("guarded.error_kind", "plain.error_kind", F.concat(F.lit("HTTP "), F.coalesce(code("guarded"), code("plain")).cast("string")))
    return last.withColumn("status", status).select(
        "reference_id", "status", F.when(F.col("status") == "downloaded", shown).alias("http_status"),
        F.when(F.col("status") == "downloaded", F.coalesce(F.when(by == "guarded", "cloudscraper").when(by == "browser", "playwright"), F.lit("requests"))).alias("fetch_method"),
        F.when(F.col("status") != "downloaded", message).alias("error_message"),
    )


def tries(max_retries: int = EXTRA_TRIES) -> int:
    """Requests that a failing URL gets in all: retries come on top of the first."""
    return max_retries + 1


def backoff(attempt: int, base: float = BACKOFF) -> float:
    """Seconds before the next try, after the attempt counted from 0."""
    return base * 2**attempt


Get = Callable[[str, str], tuple[int | None, str | None, bytes | None, str | None, float | None]]


def cascade(url: str, get: Get, sleep: Callable[[float], None], max_retries: int = EXTRA_TRIES) -> list[tuple]:
    """Attempts (url, strategy, attempt, status, error_kind, content, content_type) at one URL.

    ``get(url, strategy)`` gives (status, error kind, content, content type, seconds to wait that the server asks for).
    """
    rows: list[tuple] = []

    def plain(at: str, name: str) -> int | None:
        status = None
        for attempt in range(tries(max_retries)):
            status, error, content, kind, wait = get(at, "plain")
            rows.append((at, name, attempt, status, error, content, kind))
            if status is not None and (status < 400 or status in (403, 404)):
                break
            if attempt < max_retries:
                sleep((wait if wait is not None else DEFAULT_WAIT) if status == 429 else backoff(attempt))
        return status

    def once(at: str, strategy: str) -> int | None:
        status, error, content, kind, _ = get(at, strategy)
        rows.append((at, strategy, 0, status, error, content, kind))
        return status

    status = plain(url, "plain")
    if status == 403:
        status = once(url, "guarded")
        if status == 403 and url.lower().partition("?")[0][-4:] != ".pdf":
            status = once(url, "browser")
    if status == 404 and "%20" in url:
        for other in [url.replace("%20", by) for by in ("-", "")]:
            if (plain(other, "variation") or 599) < 400:
                break
    return rows


PARTITIONS = 32


def fetch(refs: DataFrame, get: Get, partitions: int = PARTITIONS, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """Attempts at every distinct reference's raw URL, its host rewritten; references of one host share a task, so a host
    sees one client."""
    import time

    wait = sleep or time.sleep

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["reference_id", "url", "strategy", "attempt", "http_status", "error_kind", "content", "content_type"]
        for pdf in batches:
            rows = [(i, *r) for i, u in zip(pdf["id"], pdf["raw_url"]) for r in cascade(u, get, wait)]
            yield pd.DataFrame(rows, columns=names).astype({"attempt": "int32", "http_status": "Int32"})

    host = F.regexp_extract("raw_url", r"^[^:]*://([^/?#]*)", 1)
    todo = refs.groupBy("id").agg(T.rewrite_host(F.min("raw_url")).alias("raw_url"))
    return todo.repartition(partitions, host).mapInPandas(run, FETCH_ATTEMPTS)


def refetch(rows: DataFrame, get: Get, partitions: int = PARTITIONS) -> DataFrame:
    """One browser attempt at each (reference_id, url): for pages that were fetched but had no text to convert."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["reference_id", "url", "strategy", "attempt", "http_status", "error_kind", "content", "content_type"]
        for pdf in batches:
            got = [(i, u, "browser", 0, *get(u, "browser")[:4]) for i, u in zip(pdf["reference_id"], pdf["url"])]
            yield pd.DataFrame(got, columns=names).astype({"attempt": "int32", "http_status": "Int32"})

    return rows.select("reference_id", "url").repartition(partitions, "url").mapInPandas(run, FETCH_ATTEMPTS)


def pending(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """References without a document yet."""
    return refs.join(documents.select(F.col("reference_id").alias("id")), "id", "left_anti")


def latest_status(refs: DataFrame, statuses: DataFrame) -> DataFrame:
    """References with the last status that was noted of their page; ``statuses`` only grows."""
    last = statuses.groupBy("id").agg(F.max_by(F.struct("status", "http_status", "fetched_at", "error_message"), F.struct("fetched_at", "turn")).alias("_s"))
    rows = refs.join(last, "id", "left")
    known = lambda c: F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(*[known(c) if c in ("status", "http_status", "fetched_at", "error_message") else c for c in refs.columns])
