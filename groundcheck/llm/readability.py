"""Main-content extraction by tree scoring.

Paragraph-like elements of ``min_chars`` characters or more earn a point, one for each comma and one for each hundred
characters, ``most_length`` at most, and hand them to their next ``levels`` ancestors: whole to the parent, half to the
one above, a third of that by each level beyond. Containers start from points for their tag and names and are discounted by
their share of link text. The best container gives the text, with those of its siblings that score a part ``share`` of it
(10 at least), and sibling paragraphs that have over ``sibling_chars`` characters and few links, or are shorter and have none.

Navigation, footers, buttons and elements whose class or id tells of them are dead, with all that is below; ``html``,
``body``, ``main`` and ``article`` are not judged by their names, and a ``form`` is dead only where it holds fewer than
``form_chars`` characters. A page without any live text gives the text of its dead elements.

One pass over the markup, in time that grows with its length: tag ends are searched once, and end tags find their
elements in a stack for each tag.

Defined cases: null or empty markup gives an empty text with score 0 and zero paragraphs; a page without a scoring
container gives the text of its whole body; ties go to the container that opens first; markup that never closes its
elements is closed at the end; a quote that never closes ends with its tag; "<" that begins no tag is text; repeated
pages give repeated rows; further columns are left out.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import map_slices

RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg iframe textarea".split()}
NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)")
STOP = re.compile("[>\"']")
IDENT = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title head".split()
)
DROPPED = frozenset("head nav aside footer button select".split())
NAMED = frozenset("html body main article".split())
ITEMS = frozenset("li dd dt".split())
SCORED = frozenset("p td pre blockquote li".split())
BASE = {"article": 8, "main": 8, "section": 4, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "form": -3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "th": -5,
        **{f"h{i}": -5 for i in range(1, 7)}}
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|combx|comments?|cookie\w*|footer|header|menu|modal|nav\w*|pager|popup|promo|related|share|sidebar|social|sponsor\w*|widget)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|story|text)(?:$|[\s_-])", re.I)

SCHEMA = "page_id bigint, title string, text string, n_paragraphs int, score double, container string"


class Node:
    __slots__ = ("tag", "parent", "kids", "weight", "raw", "chars", "linked", "commas", "score", "order", "bad", "dead")

    def __init__(self, tag: str, parent: "Node | None", weight: int, order: int, bad: bool):
        self.tag, self.parent, self.weight, self.order, self.bad = tag, parent, weight, order, bad
        self.kids: list[Node | str] = []
        self.raw = self.chars = self.linked = self.commas = 0
        self.score: float | None = None
        self.dead = False


def scan(markup: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes) of the markup in order; kinds are "text", "open" and "close"."""
    at, n, last, quotes = 0, len(markup), markup.rfind(">"), True
    while at < n:
        lt = markup.find("<", at)
        if lt < 0 or lt > last:  # no tag can end
            yield "text", markup[at:], ""
            return
        if lt > at:
            yield "text", markup[at:lt], ""
        if markup.startswith("<!--", lt):
            end = markup.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if markup[lt + 1] in "!?":
            at = markup.find(">", lt) + 1
            continue
        name = NAME.match(markup, lt + 1)
        if not name:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = place = name.end()
        while quotes:
            stop = STOP.search(markup, place)
            if not stop or stop[0] == ">":
                break
            close = markup.find(stop[0], stop.end())
            place = stop.end() if close < 0 else close + 1
        stop_at = markup.find(">", place)
        if stop_at < 0:  # a quote took the last tag end: quotes mean nothing from here on
            quotes, stop_at = False, markup.find(">", end)
        at, tag = stop_at + 1, name[2].lower()
        if name[1]:
            yield "close", tag, ""
        else:
            yield "open", tag, markup[end:stop_at]
            if tag in RAW and not (tag == "svg" and markup[stop_at - 1] == "/"):
                close = RAW[tag].search(markup, at)
                if not close:
                    return
                at = close.end()


def tree(markup: str) -> tuple[Node, list[Node], str]:
    """Root, elements in order of opening, and the title."""
    root = Node("html", None, 0, 0, False)
    nodes, title, in_title = [root], [], False
    path, blocks, by = [root], [0], {"html": [0]}  # open elements; places in the path of the blocks and of each tag

    def close(place: int) -> None:
        while len(path) > max(1, place):
            by[path[-1].tag].pop()
            if blocks[-1] == len(path) - 1:
                blocks.pop()
            path.pop()

    for kind, tag, attrs in scan(markup):
        if kind == "text":
            if in_title:
                title.append(tag)
            elif not tag.isspace():
                path[-1].kids.append(tag)
        elif kind == "close":
            if tag == "title":
                in_title = False
            elif by.get(tag) and (tag in BLOCK or by[tag][-1] > blocks[-1]):  # an inline element never closes the block around it
                close(by[tag][-1])
        elif tag in VOID:
            if tag in ("br", "hr"):
                path[-1].kids.append("\n")
        elif tag == "title":
            in_title = True
        elif tag not in RAW and tag != "html":
            if tag in BLOCK:  # a block ends open paragraphs, with the inline elements in them
                if path[blocks[-1]].tag == "p":
                    close(blocks[-1])
                above = path[blocks[-1]].tag
                if above == tag and tag in ("td", "tr") or above in ITEMS and tag in ITEMS:
                    close(blocks[-1])
                elif tag == "p":
                    close(blocks[-1] + 1)
            names = " ".join(a or b or c for a, b, c in IDENT.findall(attrs)) if attrs else ""
            bad, good = bool(names and BAD.search(names)), bool(names and GOOD.search(names))
            node = Node(tag, path[-1], 25 * (good - bad), len(nodes), bad and not good)
            path[-1].kids.append(node)
            nodes.append(node)
            by.setdefault(tag, []).append(len(path))
            if tag in BLOCK:
                blocks.append(len(path))
            path.append(node)
    return root, nodes, SPACE.sub(" ", _html.unescape("".join(title))).strip()


def measure(nodes: list[Node], form_chars: int) -> None:
    """Which elements are dead; characters, linked characters and commas of each live one, own and below."""
    for node in reversed(nodes):  # children come after their parents
        node.raw = sum(k.raw if isinstance(k, Node) else len(k) for k in node.kids)
    for node in nodes:
        node.dead = (
            node.parent is not None and node.parent.dead or node.tag in DROPPED
            or node.bad and node.tag not in NAMED or node.tag == "form" and node.raw < form_chars
        )
    for node in reversed(nodes):
        if node.dead:
            continue
        for kid in node.kids:
            if isinstance(kid, Node):
                node.chars += kid.chars
                node.linked += kid.chars if kid.tag == "a" else kid.linked
                node.commas += kid.commas
            else:
                text = SPACE.sub(" ", _html.unescape(kid))
                node.chars += len(text) - text.startswith(" ")
                node.commas += text.count(",") + text.count("，") + text.count("、")


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def paragraphs(node: Node, out: list[str], dead: bool = False) -> None:
    """Texts of the blocks in ``node``, in reading order; those of dead elements only where ``dead`` says so."""
    line: list[str] = []

    def end_block() -> None:
        text = SPACE.sub(" ", _html.unescape("".join(line))).strip()
        if text:
            out.append(text)
        line.clear()

    stack = [iter(node.kids)]
    ends = [True]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
            if ends.pop():
                end_block()
        elif isinstance(kid, str):
            line.append(kid)
        elif dead or not kid.dead:
            block = kid.tag in BLOCK
            if block:
                end_block()
            stack.append(iter(kid.kids))
            ends.append(block)


def extract(
    markup: str | None, min_chars: int = 25, share: float = 0.2, levels: int = 4, most_length: int = 3, sibling_chars: int = 80, form_chars: int = 250
) -> tuple[str, str, int, float, str | None]:
    """(title, text, paragraphs, score, container tag) of a page."""
    if not markup:
        return "", "", 0, 0.0, None
    root, nodes, title = tree(markup)
    measure(nodes, form_chars)
    scored: list[Node] = []
    for node in nodes:
        if node.dead or node.tag not in SCORED or node.chars < min_chars:
            continue
        points = 1 + node.commas + min(node.chars // 100, most_length)
        up, level = node.parent, 0
        while up is not None and level < levels:
            if up.score is None:
                up.score = BASE.get(up.tag, 0) + up.weight
                scored.append(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    best = max(scored, key=lambda n: (n.score * (1 - density(n)), -n.order), default=None)
    out: list[str] = []
    if best is None:
        paragraphs(root, out)
        if not out:
            paragraphs(root, out, True)
        return title, "\n".join(out), len(out), 0.0, None
    top = best.score * (1 - density(best))
    for kid in best.parent.kids if best.parent else [best]:
        if not isinstance(kid, Node) or kid.dead:
            continue
        fits = kid is best or kid.score is not None and kid.score * (1 - density(kid)) >= max(10, share * top)
        if not fits and kid.tag == "p":
            fits = kid.chars > sibling_chars and density(kid) < 0.25 or 0 < kid.chars <= sibling_chars and not kid.linked
        if fits:
            paragraphs(kid, out)
    return title, "\n".join(out), len(out), round(top, 6), best.tag


def extracted(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """Main content of every page; one narrow stage without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [extract(x if isinstance(x, str) else None) for x in pdf["html"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"].astype("Int64"), "title": [g[0] for g in got], "text": [g[1] for g in got],
                "n_paragraphs": [g[2] for g in got], "score": [float(g[3]) for g in got], "container": [g[4] for g in got],
            })

    return map_slices(pages.select(pages[key].alias("page_id"), pages[body].alias("html")), run, SCHEMA)
