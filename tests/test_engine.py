from __future__ import annotations

import http.server
import json
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from groundcheck import adapters, cli
from groundcheck.config import Settings
from groundcheck.errors import ConfigurationError, LLMParseError, LLMProviderError
from groundcheck.operators import fetching, judging, passages, reporting, retrieval, vectors
from groundcheck.pipeline import Audit, Workspace, load_run, start
from groundcheck.streaming.audits import answer_stream, audit_stream
from tests.fakes import Counting, get, script_get

ANSWER = "The data law protects people [1]. The internet law is older [2]. A guess [7].\n\n## Sources\n[1] Data law https://e.com/data\n[2] Net law https://e.com/net\n[3] Gone https://e.com/gone"


def attempts(spark, *rows):
    return spark.createDataFrame(rows, "reference_id string, url string, strategy string, attempt int, http_status int, error_kind string, content binary, content_type string")


def test_cascade():
    def server(replies):
        calls = []

        def get(url, strategy):
            calls.append((url, strategy))
            return replies(url, strategy, len(calls))

        return get, calls

    slept: list[float] = []
    get, calls = server(lambda u, s, n: (None, "timeout", None, None, None))
    assert len(fetching.cascade("http://e/x", get, slept.append)) == 3 and slept == [2.0, 4.0]
    get, calls = server(lambda u, s, n: (200, None, b"x", "t", None) if n == 2 else (None, "timeout", None, None, None))
    assert [r[3] for r in fetching.cascade("http://e/x", get, slept.append)] == [None, 200]
    get, calls = server(lambda u, s, n: (404, None, None, None, None))
    assert [r[0] for r in fetching.cascade("http://e/a%20b", get, slept.append)] == ["http://e/a%20b", "http://e/a-b", "http://e/ab"]
    get, calls = server(lambda u, s, n: (403, None, None, None, None) if s != "browser" else (200, None, b"x", "t", None))
    assert [r[1] for r in fetching.cascade("http://e/x", get, slept.append)] == ["plain", "guarded", "browser"]
    assert [r[1] for r in fetching.cascade("http://e/x.PDF?y", get, slept.append)] == ["plain", "guarded"]
    slept.clear()
    get, calls = server(lambda u, s, n: (429, None, None, None, 7.0 if n == 1 else None))
    fetching.cascade("https://e/x", get, slept.append)
    assert slept == [7.0, 60.0]


def test_hosts_are_rewritten_before_fetching(spark):
    urls = ["https://www.reddit.com/r/x", "https://reddit.com", "https://e.com/?to=https://www.reddit.com/r/x"]
    refs = spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "id string, raw_url string")
    got = {r["reference_id"]: r["url"] for r in fetching.fetch(refs, lambda u, s: (404, None, None, None, None), 2).collect()}
    assert got == {"0": "https://old.reddit.com/r/x", "1": "https://old.reddit.com", "2": urls[2]}


def test_outcomes(spark):
    rows = [
        ("ok", "u", "plain", 0, None, "timeout", None, None), ("ok", "u", "plain", 1, 200, None, b"x", "t"), ("dead", "u", "plain", 0, 404, None, None, None),
        ("slow", "u", "plain", 2, 500, None, None, None), ("wall", "u.pdf", "plain", 0, 403, None, None, None), ("wall", "u.pdf", "guarded", 0, 403, None, None, None),
        ("b", "u", "plain", 0, 403, None, None, None), ("b", "u", "guarded", 0, 403, None, None, None), ("b", "u", "browser", 0, 200, None, b"", "t"),
        ("gone", "u", "plain", 0, 403, None, None, None), ("gone", "u", "guarded", 0, 404, None, None, None), ("ssl", "u", "plain", 0, 403, None, None, None), ("ssl", "u", "guarded", 0, None, "ssl", None, None),
        ("v", "u%20x", "plain", 0, 404, None, None, None), ("v", "u-x", "variation", 0, 200, None, b"", "t"),
    ]
    got = {r["reference_id"]: r for r in fetching.outcome(attempts(spark, *rows)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"ok": "downloaded", "dead": "dead", "slow": "inaccessible", "wall": "inaccessible", "b": "downloaded", "gone": "dead", "ssl": "error", "v": "downloaded"}
    assert got["b"]["fetch_method"] == "playwright" and got["b"]["http_status"] == 200 and got["dead"]["http_status"] is None and got["slow"]["error_message"] == "HTTP 500"


def test_split_markdown():
    text = "# One\n\n" + "word " * 30 + "\n\n## Two\n\n" + "Sentence here. " * 20 + "\n\n### Three\n\nshort"
    chunks = passages.split_markdown(text, 40, 0)
    assert len(chunks) > 2 and all(passages.word_tokens(c) <= 40 for c in chunks)
    assert " ".join(" ".join(chunks).split()) == " ".join(text.split())
    lapped = passages.split_markdown("one two three four five six seven eight", 4, 2)
    assert lapped == ["one two three four", "three four five six", "five six seven eight"]
    assert passages.split_markdown("", 4) == [] and passages.split_markdown("  \n", 4) == [] and passages.split_markdown("x", 4) == ["x"]


def test_passages(spark):
    docs = spark.createDataFrame([("b", "# H\n\n" + "x " * 90), ("a", "y " * 10), ("c", ""), ("d", None)], "reference_id string, markdown string")
    rows = passages.with_ids(passages.with_sections(passages.chunk(docs, 40, 0)), 5).orderBy("embedding_id").collect()
    assert [r["embedding_id"] for r in rows] == list(range(5, 5 + len(rows))) and rows[0]["id"] == "a-0" and rows[0]["section"] is None
    fixed = passages.with_sections(passages.chunk(docs, 40, 0), first_line=True).where("reference_id = 'b'").collect()
    assert {r["section"] for r in fixed} == {"H"}


def index(spark):
    rows = [("A-0", "A", "a one", 0, [0.0, 1.0, 0.0]), ("A-1", "A", "a two", 1, [0.0, 0.9, 0.1]), ("B-0", "B", "b one", 2, [1.0, 0.0, 0.0])]
    return spark.createDataFrame(rows, "id string, reference_id string, text string, embedding_id bigint, embedding array<float>")


def asked(spark):
    q = [0.99, 0.01, 0.0]
    rows = [("c0", "x", 0, "one b", ["A"], q), ("c1", "x", 1, "t", [], q), ("c2", "x", 2, "t", ["Z", "Y"], q), ("c3", "x", 3, "t", ["Z", "B"], q)]
    return spark.createDataFrame(rows, "id string, answer_id string, position int, text string, cited_reference_ids array<string>, embedding array<float>")


def test_retrieval_is_scoped(spark):
    got = {r["answer_chunk_id"]: r for r in retrieval.curate(asked(spark), index(spark)).collect()}
    assert [p["reference_id"] for p in got["c0"]["passages"]] == ["A", "A"] and got["c0"]["skip_reason"] is None
    assert got["c1"]["skip_reason"] == retrieval.NO_CITATION and got["c1"]["assembled_context"] == ""
    assert "['Z', 'Y']" in got["c2"]["skip_reason"] and got["c2"]["passages"] == []
    assert got["c3"]["assembled_context"] == "[referencia=B score=0.990]\nb one"
    full = {r["answer_chunk_id"]: r for r in retrieval.curate(asked(spark), index(spark), full_corpus=True, keep=2).collect()}
    assert all(r["skip_reason"] is None and len(r["passages"]) == 2 and r["passages"][0]["reference_id"] == "B" for r in full.values())
    again = {r["answer_chunk_id"]: r for r in retrieval.curate(asked(spark), index(spark), full_corpus=True, reranker=retrieval.lexical_score).collect()}
    assert [p["reference_chunk_id"] for p in again["c0"]["passages"]] == ["B-0", "A-0", "A-1"] and again["c0"]["passages"][0]["score"] == 1.0
    empty = retrieval.curate(asked(spark), index(spark).where("false"), full_corpus=True).collect()
    assert all(r["passages"] == [] and r["assembled_context"] == "" for r in empty)


def test_full_search_in_blocks_equals_comparing_all(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    q, x = rng.integers(-2, 3, (40, 6)).astype(float), rng.integers(-2, 3, (300, 6)).astype(float)  # many ties
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "claim_id string, embedding array<double>")
    held = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "embedding_id bigint, embedding array<double>")
    want = {(f"q{i}", int(j), n) for i in range(40) for n, j in enumerate(np.lexsort((np.arange(300), -(x @ q[i])))[:7], 1)}
    for sizes in ((4096, 2048), (11, 50)):
        rows = vectors.top_full(queries, held, 7, *sizes).select("claim_id", "embedding_id", "rank").collect()
        assert len(rows) == 280 and set(map(tuple, rows)) == want
    few = vectors.top_full(queries, held.limit(3), 7).count()
    assert few == 120 and vectors.top_full(queries, held.where("false"), 7).count() == 0 and vectors.top_full(queries.where("false"), held, 7).count() == 0


def test_costs_and_verdicts(spark):
    first = next(iter(judging.PRICES))
    df = spark.createDataFrame([("anthropic", first, 10**6, 10**6), ("local", first, 1, 1), ("anthropic", "new", 5, 5), ("openai", first, 5, 5)], "p string, m string, a int, b int")
    assert [r[0] for r in df.select(judging.cost_usd(*map(F.col, "pmab"))).collect()] == [30.0, 0.0, 0.0, 0.0]
    own = Settings(llm_prices='{"new": [1, 2]}').prices()
    assert [r[0] for r in df.select(F.round(judging.cost_usd(*map(F.col, "pmab"), own), 6)).collect()] == [0.0, 0.0, 0.000015, 0.0]
    raw = spark.createDataFrame([('{"verdict": "supported", "justification": "j"}',), ('{"verdict": "other", "justification": "j"}',), ("nothing",)], "r string")
    assert [r[0] and r[0]["verdict"] for r in raw.select(judging.valid_verdict(F.col("r"))).collect()] == ["supported", None, None]


def test_retrying_client():
    seen, slept = [], []

    def picky(messages, **parameters):
        seen.append(sorted(parameters))
        if "response_format" in parameters:
            raise ValueError("response_format is not supported")
        if len(seen) < 4:
            raise OSError("busy")
        return "{}", 1, 2

    client = judging.RetryingClient(picky, "openai", "m", max_retries=3, sleep=slept.append)
    assert client.reply("s", "u")[:3] == ("{}", 1, 2)
    assert seen == [["response_format", "temperature"], ["temperature"], ["temperature"], ["temperature"]] and slept == [2.0, 2.0]

    def down(messages, **parameters):
        seen.append("down")
        raise OSError("down")

    seen.clear()
    with pytest.raises(LLMProviderError):
        judging.RetryingClient(down, "openai", "m", max_retries=2, sleep=slept.append).reply("s", "u")
    assert seen == ["down"] * 2

    def garbled(messages, **parameters):
        seen.append("garbled")
        raise LLMParseError("bad", "raw")

    with pytest.raises(LLMParseError):
        judging.RetryingClient(garbled, "openai", "m", sleep=slept.append).reply("s", "u")
    assert seen.count("garbled") == 1
    with pytest.raises(ConfigurationError):
        judging.client(Settings(llm_provider="anthropic"))
    with pytest.raises(ConfigurationError):
        judging.client(Settings(llm_provider="other"))
    assert isinstance(judging.client(Settings(llm_provider="openai")).call, adapters.ChatCall)  # a key is not asked for
    assert isinstance(judging.client(Settings()), judging.RetryingClient) and isinstance(judging.client(Settings(llm_provider="containment")), judging.ContainmentJudge)


class Server:
    """A chat server on this machine that answers from a script and keeps what it was sent."""

    def __init__(self, script):
        self.seen, self.script = [], script
        own = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                own.seen.append((self.path, dict(self.headers), body))
                code, reply = own.script(body, len(own.seen))
                data = json.dumps(reply).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.http = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


def chat(text: str) -> dict:
    return {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 11, "completion_tokens": 3}}


def test_chat_protocol():
    said = '{"justification": "j", "cited_excerpts": [], "verdict": "supported"}'

    def script(body, n):
        if "temperature" in body:
            return 400, {"error": "temperature is not supported with this model"}
        return (503, {"error": "busy"}) if n == 2 else (200, chat(said))

    server, slept = Server(script), []
    judge = judging.client(Settings(llm_base_url=server.url + "/v1/", openai_api_key="k", llm_model="some/model"))
    judge.sleep = slept.append
    assert judge.reply("sys", "user")[:3] == (said, 11, 3) and slept == [2.0]
    path, headers, body = server.seen[-1]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer k" and body["model"] == "some/model"
    assert body["messages"] == [{"role": "system", "content": "sys"}, {"role": "user", "content": "user"}]
    shape = body["response_format"]["json_schema"]
    assert shape["strict"] and shape["schema"]["additionalProperties"] is False and set(shape["schema"]["required"]) == {"verdict", "justification", "cited_excerpts"}
    assert judge.reply("sys", "user")[:3] == (said, 11, 3) and len(server.seen) == 4  # what was rejected is not sent again
    empty = judging.client(Settings(llm_base_url=Server(lambda b, n: (200, {"choices": []})).url))
    with pytest.raises(LLMParseError):
        empty.reply("s", "u")


def test_messages_protocol():
    reply = {"content": [{"type": "text", "text": "{}"}], "usage": {"input_tokens": 5, "output_tokens": 2}}
    server = Server(lambda body, n: (200, reply) if "temperature" not in body else (400, {"error": {"message": "temperature: not allowed"}}))
    judge = judging.client(Settings(llm_provider="anthropic", anthropic_api_key="k", llm_model="m"), adapters.MessagesCall("m", "k", server.url))
    assert judge.reply("sys", "user")[:3] == ("{}", 5, 2)
    path, headers, body = server.seen[-1]
    assert path == "/v1/messages" and headers["X-Api-Key" if "X-Api-Key" in headers else "x-api-key"] == "k"
    assert body["system"] == "sys" and body["messages"] == [{"role": "user", "content": "user"}] and body["max_tokens"] == 1024
    assert body["output_format"]["schema"]["required"] == ["verdict", "justification", "cited_excerpts"]


def test_provider_failure_keeps_what_was_paid(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "runs"))
    start(space, spark.createDataFrame([("a", "tool", ".md", ANSWER)], "answer_id string, tool_name string, suffix string, text string"))
    said = '{"justification": "j", "cited_excerpts": [], "verdict": "supported"}'
    server = Server(lambda body, n: (500, {"error": "down"}) if "internet law" in body["messages"][1]["content"].split("EVIDENCE")[0] else (200, chat(said)))
    how = Settings(llm_base_url=server.url, llm_retry_delay=0.0, judge_batch=1, llm_model="some/model")
    audit = Audit(space, get, judging.client(how), settings=how)
    with pytest.raises(LLMProviderError):
        audit.run()
    assert space.read("judge_errors").first()["error"] == "provider" and audit.pending_count() >= 1
    server.script = lambda body, n: (200, chat(said))
    asked_before = len(server.seen)
    Audit(space, get, judging.client(how), settings=how).run()
    rows = space.read("results").collect()
    assert audit.pending_count() == 0 and len(rows) == 2 and {r["judge_model"] for r in rows} == {"some/model"}
    assert len(server.seen) - asked_before == 2 - sum(r["seq"] < 2**32 for r in rows)
    text = space.report("a")
    assert "some/model" in text and server.url in text


def test_one_run_is_resumed_alone(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "runs"))
    two = [(i, "tool", ".md", ANSWER) for i in ("a", "b")]
    start(space, spark.createDataFrame(two, "answer_id string, tool_name string, suffix string, text string"))
    judge = Counting()
    Audit(space, get, judge, only="a").run()
    of = {r["answer_id"] for r in space.read("claims").collect()}
    assert of == {"a"} and space.report("a") and space.report("b") is None
    Audit(space, get, judge, only="b").run()
    assert {r["answer_id"] for r in space.read("claims").collect()} == {"a", "b"} and space.report("b") and space.report("a")
    rows = space.read("references").collect()
    assert {r["status"] for r in rows if r["answer_id"] == "b"} == {"downloaded", "dead"}


def test_whole_audit(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "runs"))
    start(space, spark.createDataFrame([("a", "tool", ".md", ANSWER)], "answer_id string, tool_name string, suffix string, text string"))
    judge = Counting()
    judge.bad = True
    audit = Audit(space, get, judge)
    audit.run()
    refs = {r["raw_url"]: r for r in space.read("references").collect()}
    assert {k: r["status"] for k, r in refs.items()} == {"https://e.com/data": "downloaded", "https://e.com/net": "downloaded", "https://e.com/gone": "dead"}
    assert space.read("claims").count() == 4 and space.read("skipped").count() == 2 and space.read("results").count() == 1
    assert space.read("judge_errors").count() == 1 and audit.pending_count() == 1
    judge.bad = False
    calls = space.read("fetch_attempts").count()
    Audit(space, get, judge).run()
    assert audit.pending_count() == 0 and space.read("results").count() == 2 and space.read("fetch_attempts").count() == calls
    row = audit.report().first()
    assert (row["total_chunks"], row["count_supported"], row["count_skipped"]) == (4, 1, 2)
    assert row["pct_supported"] == 25.0 and [d["raw_url"] for d in row["dead_references"]] == ["https://e.com/gone"]
    assert Counter(s["times_cited"] for s in row["reference_stats"]) == {1: 2, 0: 1}
    text = space.report("a")
    assert "| Modelo do juiz LLM | containment |" in text or "containment" in text
    assert "| **SUPPORTED** | 1 | 25.0% |" in text and "| **SKIPPED** | 2 | 50.0% |" in text and "| **TOTAL** | 4 | 100.0% |" in text
    assert "## 5. " in text and "- https://e.com/gone — HTTP 404" in text and "## 6. " in text and "## 7. " in text and "Referências sem nenhuma citação: 1/3 (33.3%)" in text
    assert json.loads(spark.read.parquet(f"{space.root}/report_json").first()["json"])["total_chunks"] == 4
    space.views()
    assert spark.sql("SELECT count(*) FROM claims").first()[0] == 4
    assert load_run(space, "a")["full_corpus_mode"] is False
    with pytest.raises(ConfigurationError):
        load_run(space, "zzz")


def test_page_without_text_is_fetched_by_the_browser(spark, tmp_path):
    space = Workspace(spark, str(tmp_path / "runs"))
    text = "A claim [1]. More [2].\n## Sources\n[1] S https://e.com/script\n[2] T https://e.com/blank"
    start(space, spark.createDataFrame([("a", "tool", ".md", text)], "answer_id string, tool_name string, suffix string, text string"))
    audit = Audit(space, script_get)
    audit.run()
    refs = {r["raw_url"]: r for r in space.read("references").collect()}
    assert refs["https://e.com/script"]["status"] == "downloaded" and refs["https://e.com/blank"]["status"] == "error"
    doc = space.read("documents").first()
    assert doc["fetch_method"] == "playwright" and doc["markdown"] == "A claim that a script wrote"
    n = space.read("fetch_attempts").count()
    audit.ingestion()
    assert space.read("fetch_attempts").count() == n
    Audit(space, script_get, retry_failed=True).ingestion()
    assert space.read("fetch_attempts").count() > n and space.read("documents").count() == 1
    assert (tmp_path / "runs" / "report_text" / "run_id=a").is_dir()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda n, *ids: (tmp_path / "in" / n).write_text("".join(json.dumps({"answer_id": i, "tool_name": "t", "suffix": ".md", "text": ANSWER}) + "\n" for i in ids))
    space = Workspace(spark, str(tmp_path / "runs"))
    audit = Audit(space, get)
    for name, ids in (("1.json", ["a"]), ("2.json", ["a", "b"])):
        write(name, *ids)
        audit_stream(answer_stream(spark, str(tmp_path / "in")), audit, str(tmp_path / "check")).awaitTermination()
    assert sorted(r["run_id"] for r in space.read("runs").collect()) == ["a", "b"]
    assert space.read("claims").count() == 8 and audit.pending_count() == 0 and space.read("documents").count() == 2


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    monkeypatch.setenv("LLM_PROVIDER", "containment")
    (tmp_path / "answer.md").write_text(ANSWER)
    assert cli.main(["--fetcher", "tests.fakes:get", "run", str(tmp_path / "answer.md"), "--tool", "T"], spark) == 0
    run_id = capsys.readouterr().out.strip()
    assert re.fullmatch(r"answer_[0-9a-f]{12}_\d{8}T\d{6}Z", run_id)
    assert cli.main(["report", run_id], spark) == 0 and "Relatório de Auditoria — T" in capsys.readouterr().out
    assert cli.main(["resume", run_id], spark) == 0 and "0 pending" in capsys.readouterr().out
    assert cli.main(["compare", run_id], spark) == 0 and "| T | 2 | 50.0% |" in capsys.readouterr().out
    assert cli.main(["report", "nothing"], spark) == 2
    assert cli.main(["--strategy", "model", "resume", run_id], spark) == 2  # the stand-in reads no lists


def test_pdf_answers(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("DATA_DIR", str(tmp_path))
    monkeypatch.setenv("LLM_PROVIDER", "containment")
    link = lambda u: b"<</Type/Annot/Subtype/Link/A<</S/URI/URI(" + u + b")>>>>"
    (tmp_path / "answer.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n" + link(b"https://e.com/data") + b"\nendobj\n" + link(b"https://e.com/net#top"))
    assert cli.main(["--fetcher", "tests.fakes:get", "--pdf", "tests.fakes:pdf_text", "run", str(tmp_path / "answer.pdf")], spark) == 0
    space = Workspace(spark, str(tmp_path / "runs"))
    assert {r["url"] for r in space.read("pdf_links").collect()} == {"https://e.com/data", "https://e.com/net"}
    assert {r["raw_url"] for r in space.read("references").collect()} >= {"https://e.com/data", "https://e.com/net"}


def test_settings(monkeypatch, tmp_path):
    (tmp_path / ".env").write_text("# no\nLLM_MODEL='m'\nretrieval_top_k=7\nother=1\n")
    monkeypatch.setenv("LLM_MAX_RETRIES", "9")
    s = Settings.load(str(tmp_path / ".env"))
    assert (s.llm_model, s.retrieval_top_k, s.llm_max_retries, s.llm_provider) == ("m", 7, 9, "local")
    assert Settings(llm_provider="anthropic").judge_config()["Base URL"] is None


def test_statistics(spark):
    refs = spark.createDataFrame([("a", "r1", 1, "u1", ["[1]"], "dead", None), ("a", "r2", 2, "u2", [], "error", "e"), ("a", "r3", 3, "u3", [], "downloaded", None)], "answer_id string, id string, ord int, raw_url string, citation_markers array<string>, status string, error_message string")
    claims = spark.createDataFrame([("c0", "a", 0, "t", ["r3", "ghost"]), ("c1", "a", 1, "t", ["r3", "r2"]), ("c2", "a", 2, "t", [])], "id string, answer_id string, position int, text string, cited_reference_ids array<string>")
    results = spark.createDataFrame([("c0", 1, "unsupported"), ("c0", 2, "supported")], "answer_chunk_id string, seq bigint, verdict string")
    rows = reporting.reference_stats(refs, claims, results).orderBy("place").collect()
    assert [(r["reference_id"], r["times_cited"], r["supported_count"], r["unsupported_count"]) for r in rows] == [("r3", 2, 1, 0), ("r2", 1, 0, 0), ("r1", 0, 0, 0)]
    counts = reporting.verdict_counts(results).first()
    assert (counts["count_supported"], counts["count_unsupported"], counts["count_contradicted"]) == (1, 1, 0)
    none = reporting.cost_summary(spark.createDataFrame([], "cost_usd double, prompt_tokens int, completion_tokens int")).first()
    assert tuple(none) == (0.0, 0, 0, 0)
