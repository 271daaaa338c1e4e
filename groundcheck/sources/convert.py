"""Fetched bytes to Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExtractionError
from ..functions import text as T

_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
_DROP = frozenset("script style nav noscript template aside footer form head".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())


def decode_any(raw: bytes, kind: str | None) -> str:
    """Text of fetched bytes: the declared charset where it fits strictly, else UTF-8, else Windows-1252."""
    declared = _CHARSET.search(kind or "")
    for name in ([declared[1]] if declared else []) + ["utf-8"]:
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("windows-1252", "replace")


class _Markdown(HTMLParser):
    """Headers, paragraphs and list items of a page, without menus, scripts and adverts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.prefix = ""
        self.hidden: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.line).split())
        if text:
            self.blocks.append(self.prefix + text)
        self.line, self.prefix = [], ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            if tag not in _VOID and tag == self.hidden[0]:
                self.hidden.append(tag)
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).split()
        if tag in _DROP or tag == "div" and {"ad", "ads", "advert", "sidebar", "comments"} & set(names):
            self.flush()
            self.hidden.append(tag)
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag == "li":
            self.flush()
            self.prefix = "- "
        elif tag in ("p", "div", "article", "section", "tr", "table", "ul", "ol", "blockquote", "pre", "br"):
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
        elif re.fullmatch(r"h[1-6]|p|div|li|article|section|tr|table|ul|ol|blockquote|pre", tag):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line.append(data)


def html_to_markdown(html: str) -> str:
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.flush()
    text = "\n\n".join(parser.blocks)
    if not text.strip():
        raise ExtractionError("the page has no main text")
    return text


def _no_pdf(content: bytes) -> str:
    raise ExtractionError("no PDF converter is configured")


def convert(fetched: DataFrame, pdf: Callable[[bytes], str] = _no_pdf, html: Callable[[str], str] = html_to_markdown) -> DataFrame:
    """(reference_id, markdown, error) of fetched (reference_id, url, content, content_type); an empty text is an error."""
    rows = fetched.select("reference_id", "content", F.coalesce("content_type", F.lit("")).alias("kind"), T.is_pdf(F.coalesce("content_type", F.lit("")), F.col("url")).alias("pdf"))

    def one(content: bytes, kind: str, is_pdf: bool) -> tuple[str | None, str | None]:
        try:
            text = pdf(content) if is_pdf else html(decode_any(content, kind))
        except Exception as error:  # any converter's failure is the reference's, not the job's
            return None, str(error) or type(error).__name__
        return (text, None) if text and text.strip() else (None, "no text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            got = [one(bytes(c), k, d) for c, k, d in zip(p["content"], p["kind"], p["pdf"])]
            yield pd.DataFrame({"reference_id": p["reference_id"], "markdown": [g[0] for g in got], "error": [g[1] for g in got]})

    return rows.where("content IS NOT NULL").mapInPandas(run, "reference_id string, markdown string, error string")


def documents(converted: DataFrame, methods: DataFrame) -> DataFrame:
    """Document rows of what converted, with hash and word count."""
    text = F.col("markdown")
    return converted.where(text.isNotNull()).join(methods.select("reference_id", "fetch_method"), "reference_id").select(
        "reference_id", "markdown", T.content_hash(text).alias("content_hash"), "fetch_method", T.word_count(text).alias("word_count")
    )
