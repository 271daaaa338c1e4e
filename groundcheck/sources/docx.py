"""Word documents to Markdown with the standard library: paragraphs and tables in the order of the body."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

NS = "{http://schemas.openxmlformats.org" + "/wordprocessingml/2006/main}"


def heading_level(style: str) -> int:
    """Level of a heading style, 6 at most; 0 for others."""
    m = re.fullmatch(r"heading\s*(\d)", style.strip(), re.I)
    return min(int(m[1]), 6) if m else 0


def _run(run: ElementTree.Element) -> str:
    text = "".join(
        (node.text or "") if node.tag == NS + "t" else "\t" if node.tag == NS + "tab" else "\n" if node.tag in (NS + "br", NS + "cr") else ""
        for node in run
    )
    raised = run.find(f"{NS}rPr/{NS}vertAlign")
    marks = re.findall("[0-9]+", text)
    if marks and raised is not None and raised.get(NS + "val") == "superscript":
        return "".join(map("[{}]".format, marks))
    return text


def _paragraph(p: ElementTree.Element, styles: dict[str, str]) -> str:
    runs = [r for node in p for r in ([node] if node.tag == NS + "r" else node.iter(NS + "r") if node.tag == NS + "hyperlink" else [])]
    text = "".join(map(_run, runs)).strip()
    style = p.find(f"{NS}pPr/{NS}pStyle")
    level = heading_level(styles.get(style.get(NS + "val", ""), style.get(NS + "val", ""))) if style is not None else 0
    return f"{'#' * level} {text}" if level and text else text


def _table(table: ElementTree.Element, styles: dict[str, str]) -> list[str]:
    """One block a row; a cell that spans columns is one element of the file, so it is told once."""
    rows = []
    for row in table.iter(NS + "tr"):
        cells = []
        for cell in row.findall(NS + "tc"):
            text = " ".join(t for t in (_paragraph(p, styles) for p in cell.iter(NS + "p")) if t)
            if text:
                cells.append(text)
        if cells:
            rows.append(" ".join(cells))
    return rows


def to_markdown(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        styles = {}
        if "word/styles.xml" in held.namelist():
            for style in ElementTree.fromstring(held.read("word/styles.xml")).iter(NS + "style"):
                name = style.find(NS + "name")
                if name is not None:
                    styles[style.get(NS + "styleId", "")] = name.get(NS + "val", "")
        body = ElementTree.fromstring(held.read("word/document.xml")).find(NS + "body")
    blocks: list[str] = []
    for node in body if body is not None else ():
        if node.tag == NS + "p":
            blocks.append(_paragraph(node, styles))
        elif node.tag == NS + "tbl":
            blocks += _table(node, styles)
    return "\n\n".join(filter(str.strip, blocks))
