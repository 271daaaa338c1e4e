from __future__ import annotations

import re

import pytest

from groundcheck.llm import readability as R

P = "A sentence that is long enough to count, with a comma, and some more words after it so that it scores."
PAGE = f"""<!doctype html><html><head><title>The &amp; Title</title><style>p{{}}</style></head><body>
<nav><ul><li><a href=/a>menu</a></li></ul></nav><div class="sidebar"><p>{P} {P}</p></div>
<div id=content><h1>Head</h1><p>{P}</p><p>{P}<p>{P}</div><div class=links><p><a href=x>{P}</a></p></div>
<footer><p>{P}</p></footer><script>var x = "<p>{P}</p>";</script></body></html>"""


def test_main_container():
    title, text, n, score, tag = R.extract(PAGE)
    assert (title, n, tag) == ("The & Title", 4, "div")
    assert text == "\n".join(["Head", P, P, P])
    # base 5, class weight 25, and for each paragraph 1 + 2 commas + 1 for its first hundred characters
    assert score == pytest.approx(30 + 3 * (1 + 2 + len(P) // 100))


def brute_score(paragraphs: list[str], base: float) -> float:
    return base + sum(1 + p.count(",") + min(len(p) // 100, 3) for p in paragraphs if len(p) >= 25)


def test_scores_against_brute_force():
    import random

    rng = random.Random(6)
    for _ in range(50):
        parts = [", ".join("word" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        html = "<body><section>" + "".join(f"<p>{p}</p>" for p in parts) + "</section></body>"
        _, text, n, score, tag = R.extract(html)
        if any(len(p) >= 25 for p in parts):
            assert tag == "section" and score == pytest.approx(brute_score(parts, 4)) and text == "\n".join(parts) and n == len(parts)


def test_link_density_discounts():
    html = f"<body><div><p>{P} {P}</p><p><a>{P} {P} {P}</a></p></div><div><p>{P}</p><p>{P}</p></div></body>"
    assert R.extract(html)[1] == "\n".join([P, P])


def test_siblings_that_score_are_kept():
    html = f"<body><div><p>{P}</p><p>{P}</p><p>{P}</p><p>{P}</p></div><div><p>{P}</p><p>{P}</p></div><div>short</div></body>"
    assert R.extract(html)[2] == 6


def test_ties_go_to_the_first():
    html = f"<body><section><div><p>{P} a</p></div></section><section><div><p>{P} b</p></div></section></body>"
    assert R.extract(html)[1:5:3] == (f"{P} a", "div")


@pytest.mark.parametrize("markup", ["", None, "<", "<p", "</p></p>", "<!-- open", "<a <b>>", "plain & text", "<p>" * 3000 + "x", "<div>" * 20000 + P, "<script>never closed <p>", "<b><p>x</b></p>", "&#0; &#x110000;"])
def test_broken_markup(markup):
    title, text, n, score, _ = R.extract(markup)
    assert isinstance(text, str) and n >= 0 and (n == 0) == (text == "")


def test_long_page_is_taken_whole():
    html = "<article>" + "".join(f"<p>{P} {i}</p>" for i in range(5000)) + "</article>"
    assert R.extract(html)[2] == 5000 and R.extract(html)[1].endswith("4999")


def test_table(spark, small):
    df = spark.createDataFrame([(1, PAGE, "t"), (1, PAGE, "t"), (None, PAGE, "t"), (2, None, "t"), (3, "", "t")], "page_id bigint, html string, title string")
    rows = R.extracted(df).collect()
    assert len(rows) == 5 and rows[0] == rows[1] and rows[2]["text"] == rows[0]["text"]
    assert [(r["text"], r["n_paragraphs"], r["score"]) for r in rows[3:]] == [("", 0, 0.0)] * 2
    assert R.extracted(df.where("false")).collect() == []
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in R.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = re.sub(r"\W+", "", __import__("html").unescape(re.sub(r"<[^>]*>", " ", inner)))
        if got[r["page_id"]]["container"] == "article":
            assert re.sub(r"\W+", "", got[r["page_id"]]["text"]) == want


def make(rng, depth: int = 0):
    """A random element: (tag, class, kids), kids being elements or texts."""
    if depth > 3 or depth and rng.random() < 0.35:
        parts = [rng.choice(["lorem ipsum", "a, b", "short", "some longer words that fill the line", "one, two, three, four"]) for _ in range(rng.randrange(1, 9))]
        kids = [(("a", "", [t]) if rng.random() < 0.25 else t) for t in parts]
        return rng.choice(["p", "p", "p", "pre", "blockquote"]), "", kids
    kids = [make(rng, depth + 1) for _ in range(rng.randrange(1, 5))]
    return rng.choice(["div", "section", "article", "table" if depth else "div"]), rng.choice(["", "", "", "content", "sidebar", "main-ads"]), kids


def html_of(e) -> str:
    return e if isinstance(e, str) else f"<{e[0]}" + (f' class="{e[1]}"' if e[1] else "") + ">" + "".join(map(html_of, e[2])) + f"</{e[0]}>"


def naive(top) -> tuple[float, str, str]:
    """(score, tag, text) by the definition, from the elements themselves."""
    flat: list = []
    out = lambda e: e[1] == "sidebar" and e[0] != "article"

    def walk(e, above):
        me = {"e": e, "above": above, "score": None, "order": len(flat)}
        flat.append(me)
        return [walk(k, me) for k in e[2] if not isinstance(k, str) and not out(k)]

    body = ("body", "", [top])
    root = ("html", "", [body])
    walk(root, None)

    def live(e):
        return [k for k in e[2] if isinstance(k, str) or not out(k)]

    def words(e, linked=None):
        return sum(len(k) if isinstance(k, str) else words(k) for k in live(e))

    def links(e):
        return sum(0 if isinstance(k, str) else words(k) if k[0] == "a" else links(k) for k in live(e))

    def commas(e):
        return sum(k.count(",") if isinstance(k, str) else commas(k) for k in live(e))

    for me in flat:
        if me["e"][0] in R.SCORED and words(me["e"]) >= 25:
            points = 1 + commas(me["e"]) + min(3, words(me["e"]) // 100)
            above, by = me["above"], [1, 2, 6, 9]
            for part in by:
                if above is not None:
                    if above["score"] is None:
                        above["score"] = R.BASE.get(above["e"][0], 0) + {"content": 25, "sidebar": -25}.get(above["e"][1], 0)
                    above["score"] += points / part
                    above = above["above"]
    factor = lambda e: 1 - (links(e) / words(e) if words(e) else 0)
    some = [m for m in flat if m["score"] is not None]
    if not some:
        return 0.0, None, None
    best = max(some, key=lambda m: (m["score"] * factor(m["e"]), -m["order"]))
    top_score = best["score"] * factor(best["e"])
    texts: list[str] = []

    def tell(e):
        line = ""
        for k in live(e):
            if isinstance(k, str):
                line += k
            elif k[0] == "a":
                line += "".join(k[2])
            else:
                tell(k)
        if line:
            texts.append(line)

    beside = [m for m in flat if m["above"] is best["above"]]
    for m in beside:
        e = m["e"]
        if m is best or m["score"] is not None and m["score"] * factor(e) >= max(10, 0.2 * top_score) or e[0] == "p" and (
            words(e) > 80 and 1 - factor(e) < 0.25 or 0 < words(e) <= 80 and not links(e)
        ):
            tell(e)
    return round(top_score, 6), best["e"][0], "\n".join(texts)


def test_trees_against_the_definition():
    import random

    rng = random.Random(17)
    seen = 0
    for _ in range(400):
        e = make(rng)
        score, tag, text = naive(e)
        got = R.extract("<body>" + html_of(e) + "</body>")
        if tag is not None:
            seen += 1
            assert (got[3], got[4], got[1]) == (pytest.approx(score), tag, text)
    assert seen > 200


def test_names_forms_and_dead_pages():
    assert R.extract(f"<body class=no-sidebar><div><p>{P}</p></div></body>")[1] == P
    assert R.extract(f"<body class='page sidebar'><main class=popup><p>{P}</p></main></body>")[1] == P
    assert R.extract(f"<body><form><div>{''.join(f'<p>{P}</p>' for _ in range(4))}</div></form></body>")[2] == 4
    assert R.extract(f"<body><form><p>user and pass, please, here</p></form><div><p>{P}</p></div></body>")[1] == P
    assert R.extract(f"<body><div class=sidebar><p>{P}</p></div></body>")[1] == P
    assert R.extract(f"<ul><li><p>{P}</p><li><p>{P}</p></ul>")[2] == 2


@pytest.mark.parametrize("unit, tail", [("<a ", ""), ("<a ", ">"), ('<a "x>y"', '"'), ("<div>", "</p>"), ("<b>", "</div>"), ("<li><dd>", "x"), ("<p>it's <b class='x>", ""), ("<!-", ">"), (f"<div><p>{P}", "")])
def test_time_grows_with_length(unit, tail):
    import time

    def seconds(n: int) -> float:
        page = unit * n + tail * (n if tail.startswith("</") else 1)
        began = time.process_time()
        R.extract(page)
        return time.process_time() - began

    n = 200_000 // len(unit)
    seconds(n // 8)
    assert seconds(4 * n) < 12 * seconds(n) + 0.5


def test_ten_megabytes():
    import time

    for page in ("<a " * 3_400_000, f"<div><p>{P}</div>" * 85_000):
        began = time.process_time()
        R.extract(page)
        assert time.process_time() - began < 60
