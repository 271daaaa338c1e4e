from __future__ import annotations

import urllib.parse as up

import pytest
from pyspark.sql import functions as F

from groundcheck.functions import text as T


def apply(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def by_library(url: str) -> str:
    """The same rules over the standard library."""
    url = url.strip()
    low = url.lower()
    doi = low.split("doi.org/", 1)[1].strip("/") if "doi.org/" in low else low.strip("/") if low.startswith("10.") and "/" in low else ""
    if doi:
        return "https://doi.org/" + doi
    p = up.urlsplit(up.unquote(url))
    scheme = p.scheme if p.scheme not in ("", "http", "https") else "https"
    host = p.netloc.lower().removeprefix("www.")
    if scheme == "https":
        host = host.removesuffix(":443")
    pairs = sorted(kv for kv in up.parse_qsl(p.query, keep_blank_values=True) if kv[0].lower() not in T.TRACKING)
    return up.urlunsplit((scheme, host, p.path.rstrip("/"), up.urlencode(pairs), ""))


URLS = [
    "http://www.Example.com/a/", "https://example.com/a?utm_source=x&b=2&a=1#frag", "HTTPS://EXAMPLE.com:443/P%20q//", "http://e.com:80/x", "http://e.com/?b=&a&&c=1",
    "https://e.com/a%3Fq=1", "https://e.com/50%/x?y=100%", "https://e.com/a+b?q=a+b&r=%2B&s=a%20b", "https://e.com/~u/*?k=~*", "https://e.com/é?ü=ß", "ftp://www.f.org/x/",
    "https://e.com?UTM_Medium=1&Ref=2&z=%26", "  https://e.com/t  ", "https://doi.org/10.1000/ABC/", "http://dx.doi.org/10.1/x?y=Z", "10.1234/AbC", "https://e.com/%2525", "https://e.com/a/b/../c/",
    "https://e.com/?a=2&a=1&A=0", "example.com/x/", "/rooted/path", "",
]


def test_normalize_url_against_the_library(spark):
    assert apply(spark, T.normalize_url, URLS) == [by_library(u) for u in URLS]


def test_url_equivalences(spark):
    same = ["http://www.e.com/a/", "https://e.com/a", "https://E.com/a?utm_campaign=q", "https://e.com/a#x", "https://e.com/a?gclid=1&fbclid=2"]
    assert len(set(apply(spark, T.normalize_url, same))) == 1
    assert len(set(apply(spark, lambda c: T.url_id(T.normalize_url(c)), ["https://e.com/a", "https://e.com/b", "https://e.com/A"]))) == 3
    assert len(apply(spark, lambda c: T.url_id(c), ["x"])[0]) == 16


def test_markers(spark):
    got = apply(spark, T.canonical_markers, ["a<sup>1</sup>b", "a<SUB> 12 </sub>", "x²³ y⁰", "[4]", "<sup>2</sup><sup>3</sup>", None])
    assert got == ["a[1]b", "a[12]", "x[23] y[0]", "[4]", "[2][3]", None]


def test_source_sections(spark):
    texts = ["body \n\n## Referências\n[1] x", "b\n### **REFERÊNCIAS citadas**\nx", "b\n# Sources", "b\n## Fontesx\ny", "none", "b ⁂ tail", "a\n# Fontes\nmid ⁂ end\n## References\nx", "⁂ one\n## Sources two"]
    assert apply(spark, T.strip_source_section, texts) == ["body", "b", "b", texts[3], "none", "b ⁂ tail", "a", "⁂ one"]
    assert apply(spark, T.source_tail, texts) == ["\n[1] x", " citadas**\nx", "", None, None, " tail", " end\n## References\nx", " two"]


def test_url_in_line(spark):
    lines = ["see https://e.com/a", "https://e.com/cut-p art", "https://e.com/a seen in 2025", "<u>https://e.com/a</u> rest", "https://e.com/Film_(film)", "[t](https://e.com/x)", "none", "a http://b https://c"]
    parts = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string")
    before, url = T.url_parts(F.col("v"))
    got = [(r["b"], r["u"]) for r in parts.select("i", before.alias("b"), url.alias("u")).orderBy("i").collect()]
    assert got == [("see ", "https://e.com/a"), ("", "https://e.com/cut-part"), ("", "https://e.com/a"), ("<u>", "https://e.com/a"), ("", "https://e.com/Film_(film)"), ("[t](", "https://e.com/x)"), ("", ""), ("a ", "http://bhttps://c")]


def test_fuzzy_keys_and_subsequences(spark):
    assert apply(spark, T.fuzzy_url_key, ["https://e.com/A-b%20c", "https://e.com/ab c"]) == ["https://e.com/abc"] * 2
    pairs = [("abc", "aXbYc", True), ("abc", "acb", False), ("", "x", True), ("abc", "ab", False), ("aa", "a", False), ("é1", "xé-1", True)]
    df = spark.createDataFrame(pairs, "s string, l string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", T.is_subsequence(F.col("s"), F.col("l")).alias("got")).collect())


def test_tolerant_json(spark):
    schema = "a int"
    texts = ['{"a": 1}', ' x {"a": 2} y', '```json\n{"a": 3}\n```', "no", "", '[1]', '{"a": ', "```\n{\"a\": 4}\n``` and {b}"]
    got = apply(spark, lambda c: T.json_object(c, schema)["a"], texts)
    assert got == [1, 2, 3, None, None, None, None, 4]


@pytest.mark.parametrize("length", [219, 220, 221, 400])
def test_excerpt(spark, length):
    text = "w " * 3 + "x" * (length - 6)
    got = apply(spark, T.excerpt, [text + "\n "])[0]
    assert got == (text if length <= 220 else text[:219].rstrip() + "…")


def test_small_functions(spark):
    assert apply(spark, T.word_count, ["a  b\nc", "", "  ", "x y", None]) == [3, 0, 0, 2, None]
    assert apply(spark, T.strip, ["  x y\n", "\x1cz"]) == ["x y", "z"]
    assert apply(spark, T.whole_header, ["## Title x", "# A\ntext", "text", "### B\n", "#no"]) == ["Title x", "", "", "B", ""]
    assert apply(spark, T.suffix, ["/a.b/F.MD", "x", "x.tar.GZ"]) == [".md", "", ".gz"]
    assert apply(spark, T.rewrite_host, ["https://www.reddit.com/r/x", "https://reddit.com", "https://reddit.company/x", "https://old.reddit.com/a"]) == ["https://old.reddit.com/r/x", "https://old.reddit.com", "https://reddit.company/x", "https://old.reddit.com/a"]
    assert apply(spark, T.url_variations, ["http://e/a%20b", "http://e/ab"]) == [["http://e/a-b", "http://e/ab"], []]
    df = spark.createDataFrame([("application/PDF;q", "x"), ("text/html", "http://e/A.PDF?x=1"), ("text/html", "http://e/pdf")], "k string, u string")
    assert [r[0] for r in df.select(T.is_pdf(F.col("k"), F.col("u"))).collect()] == [True, True, False]
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    assert apply(spark, lambda c: T.run_id(F.lit("stem"), c, stamp), ["x"])[0] == "stem_2d711642b726_20240506T070809Z"
