"""A query for every operator, over the synthetic tables, and the SQL that must give the same rows.

The tables have no citations, so answers are put together inside both engines: claims are documents, references pages,
verdicts labels, passages vectors under their label, calls and fetch attempts events.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, fetching, judging, passages, references, reporting, retrieval, vectors
from ..sources import answers, convert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | str) -> Column:
    return F.col(c).cast("bigint") if isinstance(c, str) else c.cast("bigint")


# ---- URLs ------------------------------------------------------------------------------------------------------------

_TRACKED = ", ".join(f"'{t}'" for t in T.TRACKING)
NORM = f"""
u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query FROM pages),
v AS (SELECT page_id, url, host, path, array_to_string(list_sort(list_filter(string_split(query, '&'),
             lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ({_TRACKED}))), '&') AS q FROM u),
norm AS (SELECT page_id, url, 'https://' || regexp_replace(regexp_replace(lower(host), '^www[.]', ''), ':443$', '') || regexp_replace(path, '/+$', '')
             || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS normalized_url FROM v)
"""


@query(f"WITH {NORM} SELECT page_id, normalized_url FROM norm")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normalized_url"))


@query(f"WITH {NORM} SELECT page_id, substr(sha256(normalized_url), 1, 16) AS reference_id FROM norm")
def reference_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_id(T.normalize_url(F.col("url"))).alias("reference_id"))


@query(f"""WITH {NORM}, e AS (SELECT 'a' || (page_id % 10) AS answer_id, page_id, url, normalized_url, page_id % 9 + 1 AS m FROM norm),
  twice AS (SELECT answer_id, page_id * 2 AS ord, url, normalized_url, m FROM e UNION ALL SELECT answer_id, page_id * 2 + 1, url || '?utm_source=z', normalized_url, m + 1 FROM e WHERE url NOT LIKE '%?%' AND url NOT LIKE '%#%'),
  firsts AS (SELECT answer_id, normalized_url, m, min(ord) AS o FROM twice GROUP BY ALL)
  SELECT t.answer_id, substr(sha256(t.normalized_url), 1, 16) AS id, t.raw_url, f.markers FROM
    (SELECT answer_id, normalized_url, arg_min(url, ord) AS raw_url FROM twice GROUP BY ALL) t
    JOIN (SELECT answer_id, normalized_url, string_agg('[' || m || ']', ' ' ORDER BY o) AS markers FROM firsts GROUP BY ALL) f USING (answer_id, normalized_url)""")
def url_dedup_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "pages")
    mark = lambda k: F.array(F.concat(F.lit("["), (F.col("page_id") % 9 + k).cast("string"), F.lit("]"))).alias("markers")
    who = F.concat(F.lit("a"), (F.col("page_id") % 10).cast("string")).alias("answer_id")
    one = e.select(who, F.lit(1).alias("source_rank"), (F.col("page_id") * 2).alias("ord"), mark(1), F.lit("").alias("title"), "url")
    plain = e.where(~F.col("url").contains("?") & ~F.col("url").contains("#"))
    two = plain.select(who, F.lit(1).alias("source_rank"), (F.col("page_id") * 2 + 1).alias("ord"), mark(2), F.lit("").alias("title"), F.concat("url", F.lit("?utm_source=z")).alias("url"))
    return references.merge(one.union(two)).select("answer_id", "id", "raw_url", F.array_join("citation_markers", " ").alias("markers"))


@query("""SELECT page_id, 'https://doi.org/10.' || (1000 + page_id % 9000) || '/abc.' || page_id AS doi, 'https://doi.org/10.' || (1000 + page_id % 9000) || '/x' || page_id || '?q=1' AS bare FROM pages""")
def doi_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = (1000 + F.col("page_id") % 9000).cast("string"), F.col("page_id").cast("string")
    link = F.concat(F.lit(" http://DX.doi.org/10."), n, F.lit("/ABC."), i, F.lit("/ "))
    bare = F.concat(F.lit("10."), n, F.lit("/X"), i, F.lit("?Q=1"))
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url(link).alias("doi"), T.normalize_url(bare).alias("bare"))


@query("""SELECT page_id, (page_id % 3 = 0 OR page_id % 4 = 1) AS pdf FROM pages""")
def pdf_url_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "Application/PDF; x").otherwise("text/html")
    url = F.concat("url", F.when(F.col("page_id") % 4 == 1, "").otherwise("x"))
    tail = F.when(F.col("page_id") % 4 == 1, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/a.PDF?x=1"))).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", T.is_pdf(kind, tail).alias("pdf"))


@query("""SELECT page_id, CASE page_id % 3 WHEN 2 THEN 'https://reddit.com.example.org/r/' ELSE 'https://old.reddit.com/r/' END || page_id AS fetch_url FROM pages""")
def host_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.array(F.lit("https://reddit.com/r/"), F.lit("https://www.reddit.com/r/"), F.lit("https://reddit.com.example.org/r/")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.rewrite_host(F.concat(host, F.col("page_id").cast("string"))).alias("fetch_url"))


@query("""SELECT page_id, lower('.' || CASE page_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'pdf' ELSE 'docx' END) AS suffix FROM pages""")
def suffix_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.element_at(F.array(F.lit(".MD"), F.lit(".pdf"), F.lit(".Docx")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.suffix(F.concat(F.lit("/data/a.b/file"), F.col("page_id").cast("string"), end)).alias("suffix"))


@query("""SELECT DISTINCT page_id % 20 AS g, string_split(url, '#')[1] AS url FROM pages""")
def pdf_hyperlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("answer_id"), F.explode(F.array("url", F.concat(F.lit("mailto:"), "url"))).alias("uri"))
    return references.pdf_links(rows).withColumnRenamed("answer_id", "g")


@query("""SELECT page_id, string_split(url, '#')[1] AS url FROM pages WHERE url LIKE 'http%'""")
def pdf_link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF file a page: its URL in a link annotation, as a plain or as a hexadecimal string, beside a link of another kind."""
    plain = F.concat(F.lit("("), F.regexp_replace("url", r"([()\\])", r"\\$1"), F.lit(")"))
    uri = F.when(F.col("page_id") % 2 == 0, plain).otherwise(F.concat(F.lit("<"), F.hex(F.col("url").cast("binary")), F.lit(">")))
    link = lambda u: F.concat(F.lit("<</Type/Annot/Subtype/Link/A<</S/URI/URI "), u, F.lit(">>>>\n"))
    content = F.concat(F.lit("%PDF-1.4\n1 0 obj\n"), link(uri), link(F.lit("(mailto:a@b.c)")), F.lit("endobj\n%%EOF")).cast("binary")
    found = answers.links_of(table(spark, sf_dir, "pages").select("page_id", content.alias("content")), "page_id")
    return references.pdf_links(found.withColumnRenamed("key", "answer_id")).withColumnRenamed("answer_id", "page_id")


# ---- text ------------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(text) AS content_hash, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count FROM documents""")
def content_hash_wordcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), big(T.word_count(F.col("text"))).alias("word_count"))


@query("""SELECT conv_id, turn, text || ' [' || (conv_id % 50) || '] [' || (turn % 9) || '] [23] end' AS text FROM conversations""")
def marker_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat("text", F.lit(" <sup> "), (F.col("conv_id") % 50).cast("string"), F.lit(" </SUP> <sub>"), (F.col("turn") % 9).cast("string"), F.lit("</sub> ²³ end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.canonical_markers(mark).alias("text"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN text ELSE regexp_replace(text, '\\s+$', '') END AS body,
  CASE doc_id % 3 WHEN 0 THEN ' citadas' || chr(10) || '[1] x' WHEN 1 THEN chr(10) || 'z' END AS tail FROM documents""")
def strip_source_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.when(F.col("doc_id") % 3 == 0, "\n\n### **REFERÊNCIAS citadas\n[1] x").when(F.col("doc_id") % 3 == 1, "\n# Sources\ny ⁂\nz").otherwise("")
    text = F.concat("text", more)
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_source_section(text).alias("body"), T.source_tail(text).alias("tail"))


_FLAT = "trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'))"


@query(f"""SELECT doc_id, CASE WHEN length({_FLAT}) > 220 THEN rtrim(substr({_FLAT}, 1, 219)) || '…' ELSE {_FLAT} END AS excerpt FROM documents""")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


_Q = "chr(10) || '\"\"\"' || chr(10)"
_RULES = (
    "Verdicts: supported, if the evidence states the claim or implies it by itself; contradicted, if it plainly conflicts with it; unsupported in all "
    "other cases, partial or vague evidence included.", "Rules: the evidence is the only source. Do not fill gaps. Ambiguity means unsupported. When in "
    "doubt between two, unsupported. Contradiction must be explicit. Ignore what came before.", "Answer with one JSON object: verdict, justification "
    "(short, in Portuguese), cited_excerpts (literal quotes of the evidence, none if unsupported).",
)


@query(f"""SELECT doc_id, md5('CLAIM:' || {_Q} || text || {_Q} || chr(10) || 'EVIDENCE:' || {_Q} || 'evidence' || chr(10) || '\"\"\"' || chr(10) || chr(10) || '{_RULES[0]}' || chr(10) || chr(10)
  || '{_RULES[1]}' || chr(10) || chr(10) || '{_RULES[2]}') AS prompt FROM documents""")
def judge_prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(judging.prompt(F.col("text"), F.lit("evidence"))).alias("prompt"))


# ---- source lists ----------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str, line: Column, head: str, groups: int = 50) -> DataFrame:
    """One answer for each group of pages: a head, and a line for each page in order; ``k`` is a page's number in it."""
    from pyspark.sql.window import Window as W

    who = F.concat(F.lit("a"), (F.col("page_id") % groups).cast("string"))
    rows = table(spark, sf_dir, "pages").withColumn("answer_id", who)
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("answer_id").orderBy("page_id")).cast("string"))
    rows = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("page_id", line.alias("line")))).alias("x"))
    return rows.select("answer_id", F.concat(F.lit(head), F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("text"))


_K = "SELECT 'a' || (page_id % 50) AS answer_id, page_id, url, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS k FROM pages"


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("answer_id", big("ord").alias("ord"), F.array_join("markers", "").alias("markers"), "title", "url")


def _bracket_line() -> Column:
    head = F.concat(F.lit("["), F.col("k"), F.lit("]"))
    return (
        F.when(F.col("page_id") % 3 == 0, F.concat(head, F.lit(" Title "), F.col("page_id").cast("string"), F.lit(" "), F.col("url")))
        .when(F.col("page_id") % 3 == 1, F.concat(head, F.lit(" [99] Title\n\n  more \n\n"), F.col("url"), F.lit(" and some prose")))
        .otherwise(F.concat(head, F.lit("\n"), F.col("url"), F.lit("</u> tail")))
    )


@query(f"""SELECT answer_id, k AS ord, '[' || k || ']' || CASE WHEN page_id % 3 = 1 THEN '[99]' ELSE '' END AS markers,
  CASE page_id % 3 WHEN 0 THEN 'Title ' || page_id WHEN 1 THEN 'Title more' ELSE '' END AS title, url FROM ({_K})""")
def bracket_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(references.bracket_entries(_answers(spark, sf_dir, _bracket_line(), "Body text [1].\n\n## Sources\n")))


@query(f"SELECT answer_id, k AS ord, '[' || k || ']' AS markers, '' AS title, url FROM ({_K})")
def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("### "), F.col("k"), F.lit(". Title, <u>"), F.substring("url", 1, 12), F.lit("</u>\n\n- <u>"), F.substr("url", F.lit(13)), F.lit("</u>"))
    return _flat(references.numbered_entries(_answers(spark, sf_dir, line, "1. body <u>no</u> ⁂\n")))


@query(f"SELECT answer_id, k AS ord, '[' || k || ']' AS markers, '' AS title, url || '%20x' AS url FROM ({_K})")
def bare_url_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(references.bare_url_entries(_answers(spark, sf_dir, F.concat(F.lit("no link\n  "), F.col("url"), F.lit(" x ")), "body ⁂")))


@query(f"SELECT answer_id, k AS ord, '[' || k || ']' AS markers, 'Title ' || k AS title, url FROM ({_K})")
def titled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(references.titled_pairs(_answers(spark, sf_dir, F.concat(F.lit("Title "), F.col("k"), F.lit(", "), F.col("url")), "body\n## Fontes\n")))


@query(f"""SELECT answer_id, CAST(CASE page_id % 50 % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS source_rank, k AS ord, '[' || k || ']' AS markers,
  CASE WHEN page_id % 50 % 3 = 1 THEN '' ELSE 'T' END AS title, url FROM ({_K})""")
def extraction_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 50 % 3
    line = F.when(kind == 0, F.concat(F.lit("["), "k", F.lit("] T "), "url")).when(kind == 1, F.concat(F.lit("⁂\n"), "url")).otherwise(F.concat(F.lit("T, "), "url"))
    rows = references.entries(_answers(spark, sf_dir, line, "body\n## References\n"))
    return rows.select("answer_id", big("source_rank").alias("source_rank"), big("ord").alias("ord"), F.array_join("markers", "").alias("markers"), "title", "url")


def _damaged(url: Column) -> Column:
    n = F.length(url)
    return F.when(F.col("page_id") % 2 == 0, F.concat(F.substr(url, F.lit(1), n - 4), F.substr(url, n - 2))).otherwise(url)


@query("""WITH p AS (SELECT page_id, page_id % 10 AS g, url, CASE WHEN page_id % 2 = 0 THEN substr(url, 1, length(url) - 4) || substr(url, length(url) - 2) ELSE url END AS raw FROM pages),
  k AS (SELECT p.page_id, p.raw, q.url AS known, replace(lower(p.raw), '-', '') AS a, replace(lower(q.url), '-', '') AS b FROM p JOIN (SELECT DISTINCT g, url FROM p) q ON p.g = q.g),
  m AS (SELECT page_id, raw, known, length(b) - length(a) AS gap FROM k WHERE a = b
    OR (length(b) = length(a) + 1 AND EXISTS (SELECT 1 FROM range(0, length(b)) r(i) WHERE substr(b, 1, i) || substr(b, i + 2) = a)))
  SELECT page_id, arg_min(known, (gap, known)) AS url FROM m GROUP BY page_id""")
def url_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("answer_id", (F.col("page_id") % 10).cast("string"))
    links = p.select("answer_id", "url")
    key = F.col("page_id").cast("string")
    refs = p.select("answer_id", key.alias("id"), F.col("page_id").alias("ord"), F.array(key).alias("citation_markers"), F.lit("").alias("title"), _damaged(F.col("url")).alias("raw_url"))
    return references.mended(refs, links).select(F.col("id").cast("bigint").alias("page_id"), "url")


# ---- claims ----------------------------------------------------------------------------------------------------------


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a citation at the end of each line but the last."""
    mark = F.concat(F.lit(" ["), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("]\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("answer_id"), F.replace("text", F.lit("\n"), mark).alias("text"))


_SEG = """seg AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, t AS text, i < n AS cited FROM (
  SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, regexp_replace(unnest(x), '^\\s+|\\s+$', '', 'g') AS t, len(x) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) WHERE t <> '')"""


@query(f"""WITH {_SEG} SELECT CAST(doc_id AS VARCHAR) AS answer_id, position, text, CASE WHEN cited THEN '[' || (doc_id % 7 + 1) || ']' ELSE '' END AS markers FROM seg""")
def answer_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.segments(_cited(spark, sf_dir)).select("answer_id", big("position").alias("position"), "text", F.array_join(F.array_distinct("markers"), "").alias("markers"))


def _marked_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two references with marks for each document: r0 has [1] to [4], r1 [4] and [5]."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("answer_id"))
    mark = lambda *n: F.array(*[F.lit(f"[{i}]") for i in n])
    both = F.array(F.struct(F.lit("r0").alias("id"), F.lit(0).alias("ord"), mark(1, 2, 3, 4).alias("m")), F.struct(F.lit("r1").alias("id"), F.lit(1).alias("ord"), mark(4, 5).alias("m")))
    return d.select("answer_id", F.explode(both).alias("r")).select("answer_id", "r.id", "r.ord", F.col("r.m").alias("citation_markers"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS answer_id, '[' || m || ']' AS marker, CASE WHEN m < 4 THEN 'r0' ELSE 'r1' END AS reference_id FROM documents, range(1, 6) t(m)""")
def marker_index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.marker_index(_marked_refs(spark, sf_dir))


@query(f"""WITH {_SEG} SELECT doc_id || '-' || position AS id, text, CASE WHEN NOT cited OR doc_id % 7 >= 5 THEN '' WHEN doc_id % 7 < 3 THEN 'r0' ELSE 'r1' END AS cited FROM seg""")
def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.claims(_cited(spark, sf_dir), _marked_refs(spark, sf_dir))
    return rows.select("id", "text", F.array_join("cited_reference_ids", " ").alias("cited"))


@query(f"""WITH {_SEG} SELECT CAST(doc_id AS VARCHAR) AS answer_id, count(*) AS chunks, count(*) FILTER (NOT cited OR doc_id % 7 >= 5) AS uncited FROM seg GROUP BY doc_id""")
def uncited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.claims(_cited(spark, sf_dir), _marked_refs(spark, sf_dir))
    return rows.groupBy("answer_id").agg(F.count("*").alias("chunks"), F.count_if(F.size("cited_reference_ids") == 0).alias("uncited"))


# ---- passages --------------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("reference_id"), F.col("text").alias("markdown"))


_WIN = """w AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS reference_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT reference_id, i AS position, array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ') AS text, CAST(len(w[i * 462 + 1 : i * 462 + 512]) AS BIGINT) AS token_count
  FROM (SELECT reference_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 512) / 462.0) AS BIGINT)))) AS i FROM w WHERE len(w) > 0))"""


@query(f"WITH {_WIN} SELECT reference_id, position, text, token_count FROM win")
def word_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.word_windows(_documents(spark, sf_dir))
    return rows.select("reference_id", big("position").alias("position"), "text", big("token_count").alias("token_count"))


@query("""WITH x AS (SELECT doc_id, unnest(range(0, len(l))) AS position, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  SELECT doc_id, position, last_value(CASE WHEN position % 5 = 0 THEN 'Part ' || position END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS section FROM x""")
def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("reference_id"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    rows = rows.withColumn("text", F.when(F.col("position") % 5 == 0, F.concat(F.lit("## Part "), F.col("position").cast("string"))).otherwise(F.concat(F.lit("## no\n"), F.col("line"), F.lit("\n."))))
    return passages.with_sections(rows).select(F.col("reference_id").alias("doc_id"), big("position").alias("position"), "section")


@query(f"WITH {_WIN} SELECT reference_id || '-' || position AS id, row_number() OVER (ORDER BY reference_id, position) - 1 AS embedding_id FROM win")
def dense_passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.with_ids(passages.word_windows(_documents(spark, sf_dir))).select("id", "embedding_id")


@query()
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passages.with_sections(passages.chunk(_documents(spark, sf_dir)))
    return passages.with_ids(rows).select("id", "reference_id", "section", "text", "token_count", "embedding_id")


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return convert.convert(p.select(F.col("page_id").cast("string").alias("reference_id"), "url", F.encode("html", "UTF-8").alias("content"), F.lit("text/html").alias("content_type")))


@query()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), vectors.HashEmbedder()).select("doc_id", "embedding")


# ---- vectors ---------------------------------------------------------------------------------------------------------


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), i).alias("id"), F.col("label").cast("string").alias("reference_id"), F.concat(F.lit("text "), i).alias("text"), F.col("vec_id").alias("embedding_id"), "embedding")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each vector; it cites its own label and the next, those of number 9 in 10 nothing."""
    own = lambda k: ((F.col("vec_id") + k) % 12).cast("string")
    cites = F.when(F.col("vec_id") % 10 == 9, F.array().cast("array<string>")).otherwise(F.array(own(0), own(1)))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("claim_id"), "embedding", cites.alias("cited_reference_ids"))


_DOT = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_SCOPE = "(a.vec_id % 10 <> 9 AND (b.label = a.vec_id % 12 OR b.label = (a.vec_id + 1) % 12))"


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS norm FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n) AS v
  FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings))""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.transform("embedding", lambda x: x * 3)).alias("v"))
    return e.select("vec_id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))), 4).alias("norm"))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("claim_id", "embedding_id", "score", big("rank").alias("rank"))


def _topk(k: int, where: str = "true") -> str:
    return f"""SELECT claim_id, embedding_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, embedding_id) AS rank
  FROM (SELECT a.vec_id AS claim_id, b.vec_id AS embedding_id, {_DOT} AS score FROM embeddings a, embeddings b WHERE {where})) WHERE rank <= {k}"""


@query(_topk(5))
def topk_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.top_full(_asked(spark, sf_dir), _passages(spark, sf_dir), 5))


@query(_topk(5, _SCOPE))
def topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(vectors.top_scoped(_asked(spark, sf_dir), _passages(spark, sf_dir), 5))


@query("SELECT vec_id AS embedding_id FROM embeddings WHERE label IN (SELECT n_regionkey FROM nation)")
def scope_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("id"))
    return vectors.in_scope(_passages(spark, sf_dir), refs).select("embedding_id")


@query(f"""SELECT claim_id, embedding_id, new AS score, row_number() OVER (PARTITION BY claim_id ORDER BY new DESC, rank) AS rank FROM (
  SELECT claim_id, embedding_id, rank, CAST(CASE WHEN claim_id = embedding_id THEN 1.0 ELSE 0.5 END AS DOUBLE) AS new FROM ({_topk(20, _SCOPE)})) QUALIFY rank <= 5""".replace("QUALIFY rank <= 5", "QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY new DESC, rank) <= 5"))
def two_tier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.top_scoped(_asked(spark, sf_dir), _passages(spark, sf_dir), 20)
    said = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"))
    return _ranked(retrieval.rerank(found, said, 5))


@query("""SELECT vec_id AS claim_id, CASE WHEN vec_id % 10 = 9 THEN 'none' WHEN vec_id % 12 = 10 THEN 'unindexed' END AS skip FROM embeddings""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.skip_reasons(_asked(spark, sf_dir).withColumnRenamed("claim_id", "id"), _passages(spark, sf_dir))
    kind = F.when(F.col("skip_reason") == retrieval.NO_CITATION, "none").when(F.col("skip_reason").contains("['10', '11']"), "unindexed")
    return rows.select("claim_id", kind.alias("skip"))


@query(f"""SELECT claim_id AS answer_chunk_id, string_agg('[referencia=' || label || ' score=' || printf('%.3f', s) || ']' || chr(10) || 'text ' || embedding_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS assembled_context
  FROM (SELECT t.*, e.label, t.score + sign(t.score) * 1e-9 AS s FROM ({_topk(3, _SCOPE)}) t JOIN embeddings e ON e.vec_id = t.embedding_id) GROUP BY 1""")
def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).withColumnRenamed("claim_id", "id").withColumn("text", F.lit(""))
    return retrieval.curate(rows, _passages(spark, sf_dir), keep=3).where("skip_reason IS NULL").select("answer_chunk_id", "assembled_context")


# ---- verdicts --------------------------------------------------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each document in one of 20 answers; it cites two pages (one where they are the same)."""
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").crossJoin(F.broadcast(n))
    cites = F.array_distinct(F.array((F.col("doc_id") % F.col("n")).cast("string"), (F.col("doc_id") * 7 % F.col("n")).cast("string")))
    return d.select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 20).cast("string").alias("answer_id"), F.col("doc_id").cast("int").alias("position"), "text", cites.alias("cited_reference_ids"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 1, "supported").otherwise("unsupported")
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("answer_chunk_id"), F.col("doc_id").alias("seq"), verdict.alias("verdict"), F.concat(F.lit("because of "), F.col("doc_id").cast("string")).alias("justification"),
        (F.col("doc_id") % 100).cast("int").alias("prompt_tokens"), F.lit(8).alias("completion_tokens"), ((F.col("doc_id") % 10) / 8).alias("cost_usd"), (F.col("doc_id") % 20).cast("string").alias("run_id"),
        F.concat(F.lit("tool"), (F.col("doc_id") % 20 % 3).cast("string")).alias("tool_name"),
    )


def _pages_as_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as references of each answer."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("ord"), F.col("url").alias("raw_url"), F.array(F.concat(F.lit("["), F.col("page_id").cast("string"), F.lit("]"))).alias("citation_markers"),
        F.element_at(F.array(*[F.lit(s) for s in ("downloaded", "dead", "inaccessible", "error")]), (F.col("page_id") % 4 + 1).cast("int")).alias("status"), F.lit(None).cast("string").alias("error_message"))
    return p.withColumn("answer_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: i.cast("string"))))


_V = "CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'supported' ELSE 'unsupported' END"
_RES = f"res AS (SELECT doc_id, {_V} AS verdict, doc_id % 100 AS pt, 8 AS ct, (doc_id % 10) / 8.0 AS cost, doc_id % 20 AS run, 'tool' || (doc_id % 20 % 3) AS tool FROM labels)"
_CNT = "count(*) FILTER (verdict = 'supported') AS {0}supported{1}, count(*) FILTER (verdict = 'unsupported') AS {0}unsupported{1}, count(*) FILTER (verdict = 'contradicted') AS {0}contradicted{1}"
_PCT = ", ".join(f"round(coalesce(count(*) FILTER (verdict = '{v}') * 100.0 / nullif({{0}}, 0), 0.0), 4)::DOUBLE AS pct_{v}" for v in ("supported", "unsupported", "contradicted"))


@query(f"""WITH {_RES}, c AS (SELECT d.doc_id % 20 AS a, r.verdict FROM documents d LEFT JOIN res r USING (doc_id))
  SELECT CAST(a AS VARCHAR) AS answer_id, count(*) AS total_chunks, {_CNT.format('count_', '')}, {_PCT.format('count(*)')} FROM c GROUP BY a""")
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir).select("answer_id", F.col("id").alias("answer_chunk_id"))
    total = c.groupBy("answer_id").agg(F.count("*").alias("total_chunks"))
    counts = reporting.verdict_counts(_results(spark, sf_dir).join(c, "answer_chunk_id"), "answer_id")
    rows = total.join(counts, "answer_id", "left").fillna(0)
    return rows.withColumns({f"pct_{v}": F.round(reporting.pct(F.col(f"count_{v}"), F.col("total_chunks")), 4) for v in ("supported", "unsupported", "contradicted")})


_STATS = f"""{_RES}, n AS (SELECT count(*) AS n FROM pages), cites AS (SELECT DISTINCT doc_id, doc_id % 20 AS a, p FROM (SELECT doc_id, doc_id % n AS p FROM documents, n UNION ALL SELECT doc_id, doc_id * 7 % n FROM documents, n)),
  per AS (SELECT a, p, count(*) AS times_cited, {_CNT.format('', '_count')} FROM cites LEFT JOIN res USING (doc_id) GROUP BY a, p),
  stats AS (SELECT CAST(x.a AS VARCHAR) AS answer_id, CAST(page_id AS VARCHAR) AS reference_id, page_id, coalesce(times_cited, 0) AS times_cited, coalesce(supported_count, 0) AS supported_count, coalesce(unsupported_count, 0) AS unsupported_count,
    coalesce(contradicted_count, 0) AS contradicted_count FROM pages CROSS JOIN range(0, 20) x(a) LEFT JOIN per ON per.a = x.a AND per.p = page_id)"""


@query(f"""WITH {_STATS} SELECT answer_id, reference_id, times_cited, supported_count, unsupported_count, contradicted_count,
  row_number() OVER (PARTITION BY answer_id ORDER BY times_cited DESC, page_id) AS place FROM stats""")
def reference_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.reference_stats(_pages_as_refs(spark, sf_dir), _claims(spark, sf_dir), _results(spark, sf_dir))
    return rows.select("answer_id", "reference_id", "times_cited", "supported_count", "unsupported_count", "contradicted_count", big("place").alias("place"))


@query(f"""WITH {_STATS} SELECT answer_id, count(*) FILTER (times_cited = 0) AS uncited, count(*) AS total, round(count(*) FILTER (times_cited = 0) * 100.0 / count(*), 4)::DOUBLE AS pct_uncited FROM stats GROUP BY 1""")
def uncited_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.reference_stats(_pages_as_refs(spark, sf_dir), _claims(spark, sf_dir), _results(spark, sf_dir))
    rows = rows.groupBy("answer_id").agg(F.count_if(F.col("times_cited") == 0).alias("uncited"), F.count("*").alias("total"))
    return rows.withColumn("pct_uncited", F.round(reporting.pct(F.col("uncited"), F.col("total")), 4))


@query(f"WITH {_RES} SELECT CAST(run AS VARCHAR) AS run_id, tool AS tool_name, {_PCT.format('count(*)')}, count(*) AS total_chunks FROM res GROUP BY run, tool")
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.tool_stats(_results(spark, sf_dir))
    return rows.withColumns({f"pct_{v}": F.round(f"pct_{v}", 4) for v in ("supported", "unsupported", "contradicted")})


@query(f"""WITH {_RES} SELECT a.ord::BIGINT AS ord, a.run_id, 'x' AS tool_name, {_PCT.format('count(doc_id)')}, count(doc_id) AS total_chunks
  FROM (VALUES (0, '7'), (1, '99'), (2, '3')) a(ord, run_id) LEFT JOIN res ON CAST(run AS VARCHAR) = a.run_id GROUP BY 1, 2, 3""")
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.compare(_results(spark, sf_dir), [("7", "x"), ("99", "x"), ("3", "x")])
    return rows.select(big("ord").alias("ord"), "run_id", "tool_name", *[F.round(f"pct_{v}", 4).alias(f"pct_{v}") for v in ("supported", "unsupported", "contradicted")], "total_chunks")


@query(f"""WITH {_RES} SELECT CAST(run AS VARCHAR) AS answer_id, verdict, n, CAST(doc_id AS VARCHAR) AS answer_chunk_id, 'because of ' || doc_id AS justification_excerpt
  FROM (SELECT *, row_number() OVER (PARTITION BY run, verdict ORDER BY doc_id) AS n FROM res SEMI JOIN documents USING (doc_id)) WHERE n <= 3""")
def top3_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.examples(_results(spark, sf_dir).drop("run_id", "tool_name"), _claims(spark, sf_dir), _pages_as_refs(spark, sf_dir))
    return rows.select("answer_id", "verdict", big("n").alias("n"), "answer_chunk_id", "justification_excerpt")


@query("""SELECT CAST(a AS VARCHAR) AS answer_id, string_agg(CASE WHEN page_id % 4 = 1 THEN CAST(page_id AS VARCHAR) END, ' ' ORDER BY page_id) AS dead,
  string_agg(CASE WHEN page_id % 4 = 2 THEN CAST(page_id AS VARCHAR) END, ' ' ORDER BY page_id) AS inaccessible FROM pages, range(0, 20) x(a) GROUP BY a""")
def dead_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _pages_as_refs(spark, sf_dir)
    ids = lambda s: reporting.failed(refs, s).select("answer_id", F.array_join(F.transform("list", lambda r: r["id"]), " ").alias(s))
    return ids("dead").join(ids("inaccessible"), "answer_id")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    r = _results(spark, sf_dir).drop("run_id", "tool_name")
    skipped = c.select(F.col("id").alias("answer_chunk_id")).join(r.select("answer_chunk_id"), "answer_chunk_id", "left_anti").withColumn("reason", F.lit("no label"))
    runs = c.select(F.col("answer_id").alias("run_id")).distinct().withColumns({"tool_name": F.lit("t"), "generated_at": F.lit("2020-01-01"), "processing_time_seconds": F.lit(1.0)})
    return reporting.report(runs, c, _pages_as_refs(spark, sf_dir), r, skipped)


@query(f"""WITH {_RES}, c AS (SELECT d.doc_id % 20 AS a, r.* FROM documents d LEFT JOIN res r USING (doc_id))
  SELECT CAST(a AS VARCHAR) AS run_id, count(*) AS total_chunks, {_CNT.format('count_', '')}, count(*) - count(verdict) AS count_skipped, round(coalesce(sum(cost), 0), 4)::DOUBLE AS total_cost_usd,
  CAST(coalesce(sum(pt + ct), 0) AS BIGINT) AS total_tokens, {_PCT.format('count(*)')} FROM c GROUP BY a""")
def report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("supported", "unsupported", "contradicted")
    return _report(spark, sf_dir).select("run_id", "total_chunks", *[f"count_{v}" for v in names], "count_skipped", F.round("total_cost_usd", 4).alias("total_cost_usd"), "total_tokens", *[F.round(f"pct_{v}", 4).alias(f"pct_{v}") for v in names])


_NL, _RULE = "chr(10)", "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_LINES = f" || {_NL} || ".join(
    ["'| **{0}** | ' || c_{1} || ' | ' || printf('%.1f', round(c_{1} * 100.0 / t, 1)) || '% |'".format(v.upper(), v) for v in ("supported", "unsupported", "contradicted")]
)


@query(f"""WITH {_RES}, r AS (SELECT CAST(d.doc_id % 20 AS VARCHAR) AS a, count(*) AS t, {_CNT.format('c_', '')}, count(*) - count(verdict) AS s, count(verdict) AS j, coalesce(sum(cost), 0) AS cost,
    CAST(coalesce(sum(pt + ct), 0) AS BIGINT) AS tokens FROM documents d LEFT JOIN res USING (doc_id) GROUP BY 1)
  SELECT a AS run_id, '# Relatório de Auditoria — t (' || a || ')' || {_RULE} || '## 1. Metadados da Execução' || {_NL} || {_NL} || '| Campo | Valor |' || {_NL} || '|---|---|' || {_NL}
    || '| **Run ID** | ' || a || ' |' || {_NL} || '| **Ferramenta** | t |' || {_NL} || '| **Gerado em** | 2020-01-01 |' || {_NL} || '| **Total de chunks** | ' || t || ' |' || {_NL} || '| **Tempo de processamento** | 1.0s |'
    || {_RULE} || '## 2. Distribuição de Vereditos' || {_NL} || {_NL} || '| Veredito | Chunks | Percentual |' || {_NL} || '|---|---|---|' || {_NL} || {_LINES}
    || CASE WHEN s > 0 THEN {_NL} || '| **SKIPPED** | ' || s || ' | ' || printf('%.1f', round(s * 100.0 / t, 1)) || '% |' ELSE '' END || {_NL} || '| **TOTAL** | ' || t || ' | 100.0% |'
    || {_RULE} || '## 3. Custo e Uso de Tokens' || {_NL} || {_NL} || '| Métrica | Valor |' || {_NL} || '|---|---|' || {_NL} || '| **Custo total estimado** | US$ ' || printf('%.4f', round(cost, 4)) || ' |' || {_NL}
    || '| **Total de tokens** | ' || tokens || ' |' || {_NL} || '| **Média de tokens por requisição** | ' || printf('%.1f', round(coalesce(tokens / nullif(j, 0), 0), 1)) || ' |' || {_NL}
    || '| **Média de custo por requisição** | US$ ' || printf('%.4f', round(coalesce(cost / nullif(j, 0), 0), 4)) || ' |' AS head FROM r""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.markdown(_report(spark, sf_dir), _pages_as_refs(spark, sf_dir))
    return rows.select("run_id", F.substring_index("markdown", "\n\n---\n\n## 4. ", 1).alias("head"))


@query("""WITH x AS (SELECT CAST(a AS VARCHAR) AS run_id, page_id, url FROM pages, range(0, 20) x(a)), c AS (SELECT CAST(d.doc_id % 20 AS VARCHAR) AS run_id, string_agg('- `' || d.doc_id || '` — no label', chr(10) ORDER BY d.doc_id)
    AS skips FROM documents d ANTI JOIN labels l USING (doc_id) GROUP BY 1), f AS (SELECT run_id, string_agg(CASE WHEN page_id % 4 = 1 THEN '- ' || url || ' — sem detalhes' END, chr(10) ORDER BY page_id) AS dead,
    string_agg(CASE WHEN page_id % 4 = 2 THEN '- ' || url || ' — sem detalhes' END, chr(10) ORDER BY page_id) AS lost FROM x GROUP BY run_id)
  SELECT run_id, '## 5. Referências Mortas e Inacessíveis' || chr(10) || chr(10) || '### Mortas (HTTP 404)' || chr(10) || chr(10) || dead || chr(10) || chr(10) || '### Inacessíveis (403/timeout/SSL)' || chr(10) || chr(10) || lost
    AS failed, coalesce('## 7. Chunks Não Auditados' || chr(10) || chr(10) || skips, '') AS skipped FROM f LEFT JOIN c USING (run_id)""")
def report_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.markdown(_report(spark, sf_dir), _pages_as_refs(spark, sf_dir))
    part = lambda p: F.regexp_extract("markdown", rf"(?s)({p}.*?)(?:\n\n---\n\n|\z)", 1)
    return rows.select("run_id", part(r"## 5\. ").alias("failed"), part(r"## 7\. ").alias("skipped"))


@query(f"""WITH {_RES}, c AS (SELECT d.doc_id % 20 AS a, r.* FROM documents d LEFT JOIN res r USING (doc_id)), p AS (SELECT count(*) AS n, count(*) FILTER (page_id % 4 = 1) AS dead FROM pages)
  SELECT CAST(a AS VARCHAR) AS run_id, CAST(count(*) AS VARCHAR) AS total_chunks, CAST(count(*) - count(verdict) AS VARCHAR) AS count_skipped, any_value(n) AS references, any_value(dead) AS dead FROM c, p GROUP BY a""")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.report_json(_report(spark, sf_dir))
    of = lambda name: F.get_json_object("json", f"$.{name}")
    return rows.select(of("run_id").alias("run_id"), of("total_chunks").alias("total_chunks"), of("count_skipped").alias("count_skipped"),
                       big(F.json_array_length(of("reference_stats"))).alias("references"), big(F.json_array_length(of("dead_references"))).alias("dead"))


@query(f"""WITH {_RES}, last AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'contradicted' ELSE verdict END AS verdict FROM res), n AS (SELECT count(*) AS n FROM pages),
  cites AS (SELECT DISTINCT doc_id, doc_id % 20 AS a, p FROM (SELECT doc_id, doc_id % n AS p FROM documents, n UNION ALL SELECT doc_id, doc_id * 7 % n FROM documents, n))
  SELECT CAST(a AS VARCHAR) AS answer_id, CAST(p AS VARCHAR) AS reference_id, count(*) AS times_cited, {_CNT.format('', '_count')} FROM cites LEFT JOIN last USING (doc_id) GROUP BY a, p""")
def last_result_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim is judged twice: the later result is the one that counts."""
    first = _results(spark, sf_dir).select("answer_chunk_id", "seq", "verdict")
    changed = F.when(F.col("seq") % 3 == 0, "contradicted").otherwise(F.col("verdict"))
    again = first.select("answer_chunk_id", (F.col("seq") + F.lit(2**32)).alias("seq"), changed.alias("verdict"))
    rows = reporting.reference_stats(_pages_as_refs(spark, sf_dir), _claims(spark, sf_dir), again.union(first))
    return rows.where("times_cited > 0").select("answer_id", "reference_id", "times_cited", "supported_count", "unsupported_count", "contradicted_count")


@query(f"WITH {_RES} SELECT CAST(run AS VARCHAR) AS run_id, round(sum(cost), 4)::DOUBLE AS total_cost_usd, CAST(sum(pt) AS BIGINT) AS total_prompt_tokens, CAST(sum(ct) AS BIGINT) AS total_completion_tokens, CAST(sum(pt + ct) AS BIGINT) AS total_tokens FROM res GROUP BY run")
def cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.cost_summary(_results(spark, sf_dir), "run_id").withColumn("total_cost_usd", F.round("total_cost_usd", 4))


@query(f"WITH {_RES} SELECT CAST(run AS VARCHAR) AS run_id, round(sum(pt + ct) / count(*), 4)::DOUBLE AS mean_tokens, round(sum(cost) / count(*), 4)::DOUBLE AS mean_cost FROM res GROUP BY run")
def cost_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reporting.cost_summary(_results(spark, sf_dir).withColumn("one", F.lit(1)), "run_id").join(_results(spark, sf_dir).groupBy("run_id").count(), "run_id")
    return rows.select("run_id", F.round(F.try_divide(F.col("total_tokens").cast("double"), "count"), 4).alias("mean_tokens"), F.round(F.try_divide("total_cost_usd", "count"), 4).alias("mean_cost"))


# ---- judging ---------------------------------------------------------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ANTI JOIN labels USING (doc_id) WHERE doc_id % 2 = 1")
def pending_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _claims(spark, sf_dir)
    skipped = c.where(F.col("position") % 2 == 0).select(F.col("id").alias("answer_chunk_id"))
    return judging.pending(c, _results(spark, sf_dir), skipped).select("id")


def _curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context for each label: those of number 0 in 5 are to be skipped, those of 1 in 5 have no passage."""
    five = F.col("doc_id") % 5
    one = F.array(F.struct(F.lit("p").alias("reference_chunk_id"), F.lit("r").alias("reference_id"), F.lit(1.0).alias("score"), F.lit("t").alias("text")))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("answer_chunk_id"), F.when(five == 1, F.slice(one, 1, 0)).otherwise(one).alias("passages"),
        F.lit("evidence").alias("assembled_context"), F.when(five == 0, F.lit("no citation")).alias("skip_reason"),
    )


@query("SELECT CAST(doc_id AS VARCHAR) AS answer_chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'skip' ELSE 'judge' END AS route FROM labels")
def route_skip_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip, ask = judging.route(_curated(spark, sf_dir))
    return skip.select("answer_chunk_id", F.lit("skip").alias("route")).union(ask.select("answer_chunk_id", F.lit("judge").alias("route")))


class _Fixed:
    provider, model = "local", "fixed"

    def reply(self, system: str, user: str) -> tuple[str, int, int, int]:
        return '{"justification": "fits", "verdict": "supported"}', 3, 2, 1


@query("SELECT CAST(doc_id AS VARCHAR) AS answer_chunk_id, CASE WHEN doc_id % 5 = 1 THEN 'unsupported' ELSE 'supported' END AS verdict, CAST(CASE WHEN doc_id % 5 = 1 THEN 0 ELSE 3 END AS BIGINT) AS prompt_tokens FROM labels SEMI JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0")
def no_passage_shortcut(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ask = judging.route(_curated(spark, sf_dir))
    results, _ = judging.judge(_claims(spark, sf_dir), ask, _Fixed())
    return results.select("answer_chunk_id", "verdict", big("prompt_tokens").alias("prompt_tokens"))


class _Sometimes:
    provider, model = "local", "sometimes"

    def reply(self, system: str, user: str) -> tuple[str, int, int, int]:
        return ("no object" if "haus" in user else '{"justification": "fits", "verdict": "contradicted"}'), 3, 2, 1


@query("""SELECT CAST(doc_id AS VARCHAR) AS answer_chunk_id, CASE WHEN doc_id % 5 <> 1 AND contains(text, 'haus') THEN 'parse' WHEN doc_id % 5 = 1 THEN 'unsupported' ELSE 'contradicted' END AS said
  FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0""")
def unparsed_stays_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ask = judging.route(_curated(spark, sf_dir))
    results, errors = judging.judge(_claims(spark, sf_dir), ask, _Sometimes())
    return results.select("answer_chunk_id", F.col("verdict").alias("said")).union(errors.select("answer_chunk_id", "error"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("event_id") % 4
    said = (
        F.when(four == 0, F.concat(F.lit("  "), "props")).when(four == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
        .when(four == 2, F.concat(F.lit("It is "), "props", F.lit(" as asked."))).otherwise(F.concat(F.lit("no object "), F.regexp_replace("props", "[{}]", "")))
    )
    return table(spark, sf_dir, "events").select("event_id", T.json_object(said, "k bigint")["k"].alias("k"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' END AS verdict, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0 END::BIGINT AS n FROM events")
def judge_output_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = F.col("event_id") % 4
    said = (
        F.when(four == 0, F.lit('{"verdict": "supported", "justification": "j", "cited_excerpts": ["a"]}')).when(four == 1, F.lit('{"verdict": "contradicted", "justification": ""}'))
        .when(four == 2, F.lit('{"verdict": "maybe", "justification": "j"}')).otherwise(F.lit('{"verdict": "supported"}'))
    )
    v = judging.valid_verdict(said)
    return table(spark, sf_dir, "events").select("event_id", v["verdict"].alias("verdict"), big(F.size(v["cited_excerpts"])).alias("n"))


@query("""SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN (user_id * 5 + event_id * 25) / 1e6 WHEN 1 THEN (user_id * 1 + event_id * 5) / 1e6 ELSE 0 END, 6)::DOUBLE AS cost FROM events""")
def call_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = F.col("event_id") % 5
    provider = F.when(five == 2, "local").when(five == 3, "openai").otherwise("anthropic")
    model = F.when(five == 1, "claude-haiku-4-5").when(five == 4, "unlisted").otherwise("claude-opus-5")
    return table(spark, sf_dir, "events").select("event_id", F.round(judging.cost_usd(provider, model, F.col("user_id"), F.col("event_id")), 6).alias("cost"))


@query("""SELECT CAST(event_id AS VARCHAR) AS reference_id, CASE event_id % 8 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'dead' WHEN 2 THEN 'inaccessible' WHEN 3 THEN 'downloaded' WHEN 4 THEN 'downloaded'
  WHEN 5 THEN 'inaccessible' WHEN 6 THEN 'error' ELSE 'downloaded' END AS status, CASE event_id % 8 WHEN 0 THEN 'requests' WHEN 3 THEN 'cloudscraper' WHEN 4 THEN 'playwright' WHEN 7 THEN 'requests' END AS fetch_method FROM events""")
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("reference_id"), (F.col("event_id") % 8).alias("m"))
    cases = {  # (strategy, attempt, status, error)
        0: [("plain", 0, None, "timeout"), ("plain", 1, 200, None)], 1: [("plain", 0, 404, None)], 2: [("plain", n, None, "connection") for n in range(3)],
        3: [("plain", 0, 403, None), ("guarded", 0, 200, None)], 4: [("plain", 0, 403, None), ("guarded", 0, 403, None), ("browser", 0, 200, None)],
        5: [("plain", 0, 403, None), ("guarded", 0, 403, None)], 6: [("plain", 0, 403, None), ("guarded", 0, None, "ssl")], 7: [("plain", 0, 404, None), ("variation", 0, 404, None), ("variation", 0, 200, None)],
    }
    rows = [(m, *a) for m, each in cases.items() for a in each]
    attempts = e.join(F.broadcast(spark.createDataFrame(rows, "m bigint, strategy string, attempt int, http_status int, error_kind string")), "m")
    attempts = attempts.withColumn("url", F.when(F.col("m") == 7, "https://e.org/a%20b").when(F.col("m") == 5, "https://e.org/a.pdf").otherwise("https://e.org/a"))
    return fetching.outcome(attempts).select("reference_id", "status", "fetch_method")


def _scripted(url: str, strategy: str) -> tuple[int | None, str | None, bytes | None, str | None, float | None]:
    """Replies as the URL says: its last part is the status of the plain client, and the browser gets everything."""
    code = 200 if strategy == "browser" else int(url.rsplit("/", 1)[1])
    return code, None, b"x" if code == 200 else None, "text/html", None


def _no_wait(_: float) -> None: ...


@query("""SELECT CAST(page_id AS VARCHAR) AS reference_id, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 3 END::BIGINT AS attempts, CASE page_id % 5 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'dead' WHEN 4 THEN 'downloaded'
  ELSE 'inaccessible' END AS status, CASE page_id % 5 WHEN 0 THEN 200 WHEN 4 THEN 200 END::BIGINT AS http_status, CASE page_id % 5 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'HTTP 500' WHEN 3 THEN 'HTTP 429' END AS error_message FROM pages""")
def fetch_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the cascade, from a scripted client: success, dead, failing, asked to wait, and walled off."""
    code = F.element_at(F.array(*[F.lit(c) for c in ("200", "404", "500", "429", "403")]), (F.col("page_id") % 5 + 1).cast("int"))
    refs = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("https://h"), (F.col("page_id") % 7).cast("string"), F.lit(".org/"), F.col("page_id").cast("string"), F.lit("/"), code).alias("raw_url"))
    attempts = fetching.fetch(refs, _scripted, 8, _no_wait)
    counts = attempts.groupBy("reference_id").agg(F.count("*").alias("attempts"))
    return fetching.outcome(attempts).join(counts, "reference_id").select("reference_id", "attempts", "status", big("http_status").alias("http_status"), "error_message")


def _scratch(spark: SparkSession) -> str:
    """A new folder that all executors reach: beside the checkpoints, or in a local session a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    own = tempfile.mkdtemp(prefix="groundcheck-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}/rows"


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines, with blank lines between, and read as a table."""
    path = _scratch(spark)
    line = F.to_json(F.struct("user_id", F.from_json("props", "k bigint")["k"].alias("k")))
    table(spark, sf_dir, "events").select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return answers.read_table(spark, path, "user_id bigint, k bigint").groupBy("user_id").agg(F.count("*").alias("rows"), F.sum("k").alias("k"))
