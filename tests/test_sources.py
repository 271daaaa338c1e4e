from __future__ import annotations

import io
import zipfile

import pytest

from groundcheck.errors import ExtractionError
from groundcheck.operators import claims, references
from groundcheck.sources import answers, convert, docx


def table(spark, *texts):
    return spark.createDataFrame([(f"a{i}", "tool", ".md", t) for i, t in enumerate(texts)], "answer_id string, tool_name string, suffix string, text string")


def refs(spark, *texts, links=None):
    rows = references.extract(table(spark, *texts), links).orderBy("answer_id", "ord").collect()
    return [[(r["raw_url"], r["citation_markers"], r["title"]) for r in rows if r["answer_id"] == f"a{i}"] for i in range(len(texts))]


def test_bracket_lists(spark):
    got = refs(
        spark, "[1] One\n\nhttps://e.com/1\n\n[2] [5] Two\n\nhttps://e.com/2\n", "[1] Long\nhttps://e.com/cut-p art\n", "[1] T\nhttps://e.com/p seen on ten of May\n",
        "[1] T\n<u>https://e.com/p</u> rest\n", "Just text [1] without a list.", "[1] no url\n[2] T http://e.com/x\r\n[3]\n", "[1] A http://e.com/a\n[2] B http://www.e.com/a/\n[1] C http://e.com/a",
    )
    assert got[0] == [("https://e.com/1", ["[1]"], "One"), ("https://e.com/2", ["[2]", "[5]"], "Two")]
    assert got[1:4] == [[("https://e.com/cut-part", ["[1]"], "Long")], [("https://e.com/p", ["[1]"], "T")], [("https://e.com/p", ["[1]"], "T")]]
    assert got[4] == [] and got[5] == [("http://e.com/x", ["[2]"], "T")]
    assert got[6] == [("http://e.com/a", ["[1]", "[2]"], "A")]


def test_asterism_lists(spark):
    got = refs(
        spark, "⁂ \n\n2. <u>http://e.org/a</u> 3. <u>http://e.org/b</u> \n", "⁂\n\n1. <u>https://e.com/long-</u>\n\n### - <u>rest</u>\n2. <u>https://e.com/a b.pdf</u>",
        "## Resumo de Fontes\n1. prose\n2. more\n⁂\n1. <u>https://e.com/z</u>", "x ⁂\nhttps://e.com/1\n\nhttps://e.com/2 x.pdf", "[1] T https://e.com/t\n⁂\n1. <u>https://e.com/u</u>",
        "1. <u>https://e.com/no-anchor</u>",
    )
    assert got[0] == [("http://e.org/a", ["[2]"], ""), ("http://e.org/b", ["[3]"], "")]
    assert got[1] == [("https://e.com/long-rest", ["[1]"], ""), ("https://e.com/a%20b.pdf", ["[2]"], "")]
    assert got[2] == [("https://e.com/z", ["[1]"], "")] and got[5] == []
    assert got[3] == [("https://e.com/1", ["[1]"], ""), ("https://e.com/2%20x.pdf", ["[2]"], "")]
    assert got[4] == [("https://e.com/t", ["[1]"], "T"), ("https://e.com/u", ["[1]"], "")]


def test_headed_lists(spark):
    got = refs(
        spark, "x\n### **Referências citadas**\n1. A title, <u>https://e.com/1</u>\n2. <u>https://e.com/2</u>", "body\n### Referências citadas\nFirst title, https://e.com/1\n\nSecond, https://e.com/2",
        "# Sources\n[7] T https://e.com/7\nAlso, https://e.com/8",
    )
    assert got[0] == [("https://e.com/1", ["[1]"], ""), ("https://e.com/2", ["[2]"], "")]
    assert got[1] == [("https://e.com/1", ["[1]"], "First title"), ("https://e.com/2", ["[2]"], "Second")]
    assert got[2] == [("https://e.com/7", ["[7]"], "T")]


def test_repair_from_links(spark):
    text = "[1] https://e.com/artificial-intelligence\n[2] https://e.com/conict\n[3] https://e.com/lookalike\n[4] https://e.com/abcdefghij"
    rows = table(spark, text).selectExpr("answer_id", "tool_name", "'.pdf' AS suffix", "text")
    known = ["https://e.com/artificialintelligence", "https://e.com/conflict", "https://e.com/other", "https://e.com/aXXbXXcXXdefghij"]
    links = spark.createDataFrame([("a0", k) for k in known], "answer_id string, url string")
    got = [r["raw_url"] for r in references.extract(rows, links).orderBy("ord").collect()]
    assert got == ["https://e.com/artificialintelligence", "https://e.com/conflict", "https://e.com/lookalike", "https://e.com/abcdefghij"]
    untouched = [r["raw_url"] for r in references.extract(table(spark, text), links).orderBy("ord").collect()]
    assert untouched[1] == "https://e.com/conict"


def test_model_entries(spark):
    def model(text):
        return {"good": 'Sure: {"references": [{"citation_markers": ["[1]"], "url": "https://e.com/1", "title": "T"}, {"citation_markers": ["[2]"], "url": "https://www.e.com/1/", "title": null}]}', "bad": "no"}[text]

    rows = references.extract(table(spark, "good", "bad"), model=model).collect()
    assert [(r["answer_id"], r["citation_markers"], r["status"]) for r in rows] == [("a0", ["[1]", "[2]"], "pending")]


def test_pdf_links(spark):
    rows = spark.createDataFrame([("a", u) for u in ("https://e.com/x#p", "https://e.com/x", "mailto:a@b.c", "HTTP://e.com/y", None)], "answer_id string, uri string")
    assert [r["url"] for r in references.pdf_links(rows).collect()] == ["https://e.com/x"]


def test_claims(spark):
    text = ["A law [1]. B law [2][3] \n[1]. Tail", "no marks", " \n ", "x <sup>1</sup> y ² z [9]", "[1] [2]", "a [ 1 ] b"]
    answers_ = table(spark, *text)
    known = spark.createDataFrame([(f"a{i}", "r1", 1, ["[1]", "[2]"]) for i in range(6)] + [(f"a{i}", "r2", 2, ["[2]", "[3]"]) for i in range(6)], "answer_id string, id string, ord int, citation_markers array<string>")
    rows = claims.claims(answers_, known).orderBy("answer_id", "position").collect()
    got = {i: [(r["position"], r["text"], r["cited_reference_ids"]) for r in rows if r["answer_id"] == f"a{i}"] for i in range(6)}
    assert got[0] == [(0, "A law", ["r1"]), (1, ". B law", ["r2", "r1"]), (2, ". Tail", [])]
    assert got[1] == [(0, "no marks", [])] and got[2] == [] and got[4] == []
    assert got[3] == [(0, "x", ["r1"]), (1, "y", ["r2"]), (2, "z", [])] and got[5] == [(0, "a", ["r1"]), (1, "b", [])]
    assert rows[0]["id"] == "a0-0"


def word_file(body: str) -> bytes:
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {space}><w:style w:styleId="T2"><w:name w:val="heading 2"/></w:style></w:styles>')
    return out.getvalue()


def run(text: str, up: bool = False) -> str:
    return f"<w:r>{'<w:rPr><w:vertAlign w:val=\"superscript\"/></w:rPr>' if up else ''}<w:t>{text}</w:t></w:r>"


def test_word_files(spark, tmp_path):
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="T2"/></w:pPr>{run("Head")}</w:p><w:p>{run("Fact")}{run("1, 2", True)}{run("th", True)}<w:hyperlink>{run(" link")}</w:hyperlink></w:p><w:p/>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('a')}</w:p></w:tc><w:tc><w:p>{run('b')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p>{run('end')}</w:p>"
    )
    assert docx.to_markdown(word_file(body)) == "## Head\n\nFact[1][2]th link\n\na b\n\nend"
    assert [docx.heading_level(s) for s in ("Heading 1", "heading9", "Title", "Heading 12")] == [1, 6, 0, 0]
    (tmp_path / "one.docx").write_bytes(word_file(body))
    (tmp_path / "two.MD").write_text("é text", encoding="utf-8")
    got = {r["suffix"]: r for r in answers.read_answers(spark, str(tmp_path), "t").collect()}
    assert got[".md"]["text"] == "é text" and got[".docx"]["text"].startswith("## Head") and got[".md"]["answer_id"].startswith("two_")
    (tmp_path / "three.txt").write_text("x")
    with pytest.raises(ExtractionError):
        answers.read_answers(spark, str(tmp_path), "t")


def test_json_tables(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"answer_chunk_id": "a", "reason": "r"}\n\n{"answer_chunk_id": "b", "reason": null}\n')
    (tmp_path / "list.json").write_text('[{"answer_chunk_id": "a", "reason": "r"},\n {"answer_chunk_id": "b"}]')
    schema = "answer_chunk_id string, reason string"
    assert answers.read_table(spark, str(tmp_path / "rows.jsonl"), schema).count() == 2
    assert answers.read_table(spark, str(tmp_path / "missing"), schema).count() == 0
    assert answers.read_json_array(spark, str(tmp_path / "list.json"), schema).count() == 2


def test_decoding_and_conversion(spark):
    assert convert.decode_any("ação".encode("iso8859-1"), "text/plain;charset=iso-8859-1") == "ação"
    assert convert.decode_any("é".encode(), "text/html; charset=nonsense") == "é"
    assert convert.decode_any("é".encode(), "text/html; charset=ascii") == "é" and convert.decode_any(b"\xe9\x93", "text/html") == "é“"
    html = "<html><head><title>x</title></head><body><nav>menu</nav><h2>Head</h2><p>One <b>two<br>three<p>four &amp; five<ul><li>item</ul><div class='ad'>buy</div><script>no</script>"
    assert convert.html_to_markdown(html) == "## Head\n\nOne two\n\nthree\n\nfour & five\n\n- item"
    with pytest.raises(ExtractionError):
        convert.html_to_markdown("<nav>only</nav>")
    rows = [("r1", "http://e/x", html.encode(), "text/html"), ("r2", "http://e/x.pdf", b"%PDF", ""), ("r3", "http://e/y", b" ", None), ("r4", "http://e/z", None, "text/html")]
    fetched = spark.createDataFrame(rows, "reference_id string, url string, content binary, content_type string")
    got = {r["reference_id"]: r for r in convert.convert(fetched, pdf=lambda b: "pdf text").collect()}
    assert got["r1"]["markdown"].startswith("## Head") and got["r2"]["markdown"] == "pdf text" and got["r3"]["error"] and "r4" not in got
    assert "PDF" in {r["reference_id"]: r["error"] for r in convert.convert(fetched).collect()}["r2"]
