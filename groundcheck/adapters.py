"""Adapters to what is outside: chat models, HTTP, a browser, embedding and reranking models, PDF converters.

Optional libraries are looked for when an adapter is called, on the machine that calls it, and a missing one is an error
that names it; nothing is replaced by a stand-in unasked.
"""

from __future__ import annotations

import importlib
import json
import os
import tempfile
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import ConfigurationError, ExtractionError, LLMParseError, LLMProviderError

TIMEOUT, MOST_TOKENS = 600.0, 1024
NAVIGATION_MS, SETTLE_MS = 45_000, 2_000
AGENT = {"User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36", "Accept-Language": "pt-BR,pt;q=0.9,en;q=0.8"}
Reply = tuple[int | None, str | None, bytes | None, str | None, float | None]


def named(path: str):
    """The object at ``module:name``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


# ---- chat models -----------------------------------------------------------------------------------------------------


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    """The JSON reply; what the server says of an error is in the message, so that a rejected parameter is named."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as error:
        raise LLMProviderError(f"HTTP {error.code}: {error.read().decode('utf-8', 'replace')[:2000]}") from error
    except (OSError, ValueError) as error:
        raise LLMProviderError(f"{type(error).__name__}: {error}") from error


class ChatCall:
    """The chat-completions protocol of hosted and local servers."""

    optional = ("temperature", "response_format")

    def __init__(self, model: str, base_url: str | None, api_key: str | None, timeout: float = TIMEOUT):
        self.model, self.timeout = model, timeout
        self.url = (base_url or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"
        self.headers = {"Authorization": f"Bearer {api_key or 'not-needed'}"}

    def parameters(self, temperature: float, schema: dict) -> dict[str, object]:
        shape = {"strict": True, "name": "reply", "schema": schema}
        return {"temperature": temperature, "response_format": {"type": "json_schema", "json_schema": shape}}

    def __call__(self, messages: list[dict], **parameters: object) -> tuple[str, int, int]:
        got = _post(self.url, {"model": self.model, "messages": messages, **parameters}, self.headers, self.timeout)
        try:
            text = got["choices"][0]["message"].get("content") or ""
        except (KeyError, IndexError, TypeError, AttributeError) as error:
            raise LLMParseError("no message in the reply", json.dumps(got)) from error
        usage = got.get("usage") or {}
        return text, int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0)


class MessagesCall:
    """The messages protocol, with the declared shape as output format."""

    optional = ("temperature",)

    def __init__(self, model: str, api_key: str, base_url: str = "https://api.anthropic.com", timeout: float = TIMEOUT, most: int = MOST_TOKENS):
        self.model, self.timeout, self.most = model, timeout, most
        self.url = base_url.rstrip("/") + "/v1/messages"
        self.headers = {"x-api-key": api_key, "anthropic-version": "2023-06-01", "anthropic-beta": "structured-outputs-2025-11-13"}

    def parameters(self, temperature: float, schema: dict) -> dict[str, object]:
        return {"temperature": temperature, "output_format": {"type": "json_schema", "schema": schema}}

    def __call__(self, messages: list[dict], **parameters: object) -> tuple[str, int, int]:
        system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
        body = {"model": self.model, "max_tokens": self.most, "system": system, "messages": [m for m in messages if m["role"] != "system"], **parameters}
        got = _post(self.url, body, self.headers, self.timeout)
        text = "".join(part.get("text", "") for part in got.get("content") or () if part.get("type") == "text")
        usage = got.get("usage") or {}
        return text, int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0)


# ---- pages -----------------------------------------------------------------------------------------------------------


def _plain(url: str) -> Reply:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=AGENT), timeout=60) as reply:
            return reply.status, None, reply.read(), reply.headers.get("Content-Type", ""), None
    except urllib.error.HTTPError as error:
        wait = error.headers.get("Retry-After", "")
        return error.code, None, None, None, float(wait) if wait.isdigit() else None
    except (OSError, ValueError) as error:
        return None, "timeout" if isinstance(error, TimeoutError) else type(error).__name__, None, None, None


def _guarded(url: str) -> Reply:
    try:
        import cloudscraper
    except ImportError:
        return None, "the guarded strategy needs cloudscraper", None, None, None
    try:
        reply = cloudscraper.create_scraper().get(url, headers=AGENT, timeout=(10, 60))
        return reply.status_code, None, reply.content, reply.headers.get("Content-Type", ""), None
    except Exception as error:  # a client of many kinds of failure
        return None, type(error).__name__, None, None, None


def _browser(url: str) -> Reply:
    try:
        from playwright.sync_api import sync_playwright
    except ImportError:
        return None, "the browser strategy needs playwright", None, None, None
    try:
        with sync_playwright() as held, held.chromium.launch() as browser:
            tab = browser.new_context(extra_http_headers=AGENT).new_page()
            tab.set_default_navigation_timeout(NAVIGATION_MS)
            tab.goto(url, wait_until="domcontentloaded")
            tab.wait_for_timeout(SETTLE_MS)
            return 200, None, tab.content().encode(), "text/html", None
    except Exception as error:  # a client of many kinds of failure
        return None, type(error).__name__, None, None, None


def http_get(url: str, strategy: str) -> Reply:
    """One request by one strategy: (status, error kind, content, content type, seconds to wait)."""
    return {"plain": _plain, "guarded": _guarded, "browser": _browser}[strategy](url)


# ---- models of text --------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _sentence_model(kind: str, name: str, cache: str):
    try:
        import sentence_transformers
    except ImportError as error:
        raise ConfigurationError(f"model {name!r} needs sentence-transformers") from error
    return getattr(sentence_transformers, kind)(name, cache_folder=cache)


class SentenceEmbedder:
    """A sentence model by name; a worker loads it once."""

    def __init__(self, name: str, cache: str = "./model_cache"):
        self.name, self.cache = name, cache

    @property
    def dimension(self) -> int:
        return _sentence_model("SentenceTransformer", self.name, self.cache).get_sentence_embedding_dimension()

    def encode(self, batch: Sequence[str]) -> Sequence[Sequence[float]]:
        return _sentence_model("SentenceTransformer", self.name, self.cache).encode(list(batch), normalize_embeddings=True, show_progress_bar=False)


def cross_encoder(name: str, cache: str = "./model_cache") -> Callable[[Column, Column], Column]:
    """A reranking expression: the score that a cross-encoder gives to claim and passage."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _sentence_model("CrossEncoder", name, cache)
        for claims, texts in batches:
            yield pd.Series(model.predict(list(zip(claims.fillna(""), texts.fillna(""))), show_progress_bar=False), dtype="float64")

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def token_counter(path: str) -> Callable[[str], int]:
    """Tokens of a text by a tokenizer file of the ``tokenizers`` library."""

    def count(text: str) -> int:
        return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)

    return count


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pdf_markdown(content: bytes) -> str:
    """A PDF's text as Markdown."""
    try:
        import pymupdf4llm
    except ImportError as error:
        raise ExtractionError("PDF text needs pymupdf4llm, or another converter by --pdf module:function") from error
    with tempfile.NamedTemporaryFile(suffix=".pdf", delete=False) as file:
        file.write(content)
    try:
        text = pymupdf4llm.to_markdown(file.name)
    finally:
        os.unlink(file.name)
    if (text or "").isspace() or not text:
        raise ExtractionError("the PDF has no text")
    return text
