"""Text and URL functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid mc_cid mc_eid igshid ref ref_src spm yclid msclkid".split()
)
URL = r"https?://[^()<>\[\]\s\"]+"
MARKER_RUN = r"\[\s*\d+\s*\](?:\s*\[\s*\d+\s*\])*"
HEADING = r"(?imud)^[#]{1,6}\s*[*]*\s*(?:bibliografia|fontes|sources|refer(?:ences|[eê]ncias))\b"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"
ASTERISM = "⁂"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
EXCERPT = 220
#: White space as Python has it.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS = r"(?U)[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    """White space off both ends, Unicode's included."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _strip_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^/+|/+\z", "")


def doi_key(url: Column) -> Column:
    """Lower-case DOI of a resolver link or a bare DOI; null where there is none."""
    low = F.lower(url)
    after = F.substr(low, F.locate("doi.org/", low) + 8)
    found = F.when(low.contains("doi.org/"), _strip_slashes(after)).when(low.startswith("10.") & low.contains("/"), _strip_slashes(low))
    return F.nullif(found, F.lit(""))


def percent_decode(c: Column) -> Column:
    """Percent escapes decoded once; stray per cents and plus signs stay."""
    safe = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), c)


def _form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")), c)


def _form_encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(query: Column) -> Column:
    """Parameters without tracking, sorted and encoded anew."""
    part = lambda p, n: F.regexp_extract(p, r"(?s)^([^=]*)=?(.*)\z", n)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(_form_decode(part(p, 1)).alias("k"), _form_decode(part(p, 2)).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_form_encode(p["k"]), F.lit("="), _form_encode(p["v"]))), "&")


def normalize_url(raw: Column) -> Column:
    """One spelling for URLs of one page: https, lower-case host without www., no fragment, sorted parameters."""
    url = strip(raw)
    doi = doi_key(url)
    plain = F.regexp_replace(F.regexp_replace(percent_decode(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.when(scheme != "", F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")).otherwise(plain)
    host = F.lower(F.regexp_extract(rest, r"^//([^/?#]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    whole = F.when(scheme.isin("http", "https", ""), F.lit("https")).otherwise(scheme)
    host = F.when(whole == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1), r"/+\z", "")
    query = _query(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1))
    body = (
        F.when(host != "", F.concat(F.lit("//"), host, F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit("")), path))
        .when(path.startswith("//") | (whole.isin("https", "ftp", "file") & ((path == "") | path.startswith("/"))), F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    query = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.when(doi.isNotNull(), F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.concat(whole, F.lit(":"), body, query))


def url_id(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 16)


def run_id(stem: Column, content: Column, at: Column) -> Column:
    return F.concat_ws("_", stem, F.substring(F.sha2(content, 256), 1, 12), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))


def url_parts(text: Column) -> tuple[Column, Column]:
    """(what stands before the first URL, the URL) of a line; '' without one.

    A single token after the URL, cut off by a space, is glued on unless it opens a tag.
    """
    split = r"(?s)^(.*?)(" + URL + r")(.*)\z"
    before, url, after = (F.regexp_extract(text, split, n) for n in (1, 2, 3))
    after = strip(after)
    glue = (after != "") & ~after.contains(" ") & ~after.startswith("<")
    return before, F.when((url != "") & glue, F.concat(url, after)).otherwise(url)


def fuzzy_url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(percent_decode(url), r"(?U)[-\s]", ""))


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the characters of ``short`` stand in ``long`` in this order."""
    matched = F.aggregate(F.split(long, ""), F.lit(0), lambda n, c: F.when(F.substr(short, n + 1, F.lit(1)) == c, n + 1).otherwise(n))
    return (short == "") | (matched >= F.length(short))


def canonical_markers(text: Column) -> Column:
    """Superscript and subscript citation marks as [n]."""
    for tag in ("sup", "sub"):
        text = F.regexp_replace(text, rf"(?i)<{tag}>\s*(\d+)\s*</{tag}>", "[$1]")
    raised = F.translate(F.regexp_replace(text, f"([{SUPERSCRIPTS}]+)", "[$1]"), SUPERSCRIPTS, "0123456789")
    some = reduce(Column.__or__, [text.contains(c) for c in SUPERSCRIPTS])  # a byte search each, much faster than a class of them
    return F.when(some, raised).otherwise(text)


def _heading(text: Column) -> tuple[Column, Column]:
    """Place of the first source-list heading and of what follows it, from 1; 0 without one."""
    at = F.regexp_instr(text, F.lit(HEADING))
    return at, F.when(at > 0, at + F.length(F.regexp_extract(text, f"({HEADING})", 1))).otherwise(0)


def strip_source_section(text: Column) -> Column:
    """The body: all before the first source-list heading, white space off its end."""
    at, _ = _heading(text)
    return F.when(at > 0, F.rtrim(F.substr(text, F.lit(1), at - 1), F.lit(BLANKS))).otherwise(text)


def heading_tail(text: Column) -> Column:
    _, end = _heading(text)
    return F.when(end > 0, F.substr(text, end))


def asterism_tail(text: Column) -> Column:
    at = F.locate(ASTERISM, text)
    return F.when(at > 0, F.substr(text, at + 1))


def source_tail(text: Column) -> Column:
    """What follows the later of the asterism and the first source-list heading; null without either."""
    star = F.locate(ASTERISM, text)
    _, end = _heading(text)
    start = F.greatest(F.when(star > 0, star + 1).otherwise(0), end)
    return F.when(start > 0, F.substr(text, start))


def is_pdf(content_type: Column, url: Column) -> Column:
    return F.lower(content_type).contains("application/pdf") | F.substring_index(F.lower(url), "?", 1).endswith(".pdf")


def rewrite_host(url: Column) -> Column:
    """Discussion pages are fetched from the host that serves plain HTML."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://)(?:www\.)?reddit\.com(?=[/?#]|\z)", "$1old.reddit.com")


def url_variations(url: Column) -> Column:
    """What to try in turn when a URL with an escaped space is dead."""
    swap = lambda by: F.replace(url, F.lit("%20"), F.lit(by))
    return F.when(url.contains("%20"), F.array(swap("-"), swap(""))).otherwise(F.array().cast("array<string>"))


def json_object(text: Column, schema: str) -> Column:
    """The object in a model's reply: the whole of it, in a fence, or between the outer braces; null without one."""
    try_ = lambda t: F.from_json(F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), t), schema)
    fenced = F.regexp_extract(text, r"(?s)`{3}(?:json|)\s*([{].*?[}])\s*`{3}", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[try_(strip(t)) for t in (text, fenced, bare)])


def excerpt(text: Column, length: int = EXCERPT) -> Column:
    flat = F.array_join(words(text), " ")
    cut = F.regexp_replace(F.substring(flat, 1, length - 1), r"\s+\z", "")
    return F.when(F.length(flat) > length, F.concat(cut, F.lit("…"))).otherwise(flat)


def whole_header(text: Column) -> Column:
    """Title of a passage that is one header line and nothing else; '' for others."""
    return F.regexp_extract(text, r"^#{1,6}\s+([^\n]*)\n?\z", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
