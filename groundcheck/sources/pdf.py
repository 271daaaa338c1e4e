"""Web links of PDF files with the standard library: the URIs of link annotations, in plain and compressed objects.

An encrypted or broken file gives the links that can be read, or none; nothing is raised.
"""

from __future__ import annotations

import re
import zlib

STREAM = re.compile(rb"stream\r?\n")
URI = re.compile(rb"/URI\s*([(<])")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(content: bytes) -> list[bytes]:
    """What stands outside streams, and the streams that unpack."""
    parts, at = [], 0
    while found := STREAM.search(content, at):
        parts.append(content[at : found.start()])
        end = content.find(b"endstream", found.end())
        end = len(content) if end < 0 else end
        try:
            parts.append(zlib.decompressobj().decompress(content[found.end() : end]))
        except zlib.error:  # not packed this way: an image or a font
            pass
        at = end + 9
    return [*parts, content[at:]]


def _literal(data: bytes, at: int) -> bytes:
    """The string after an opening bracket, with balanced brackets inside and escapes undone."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            following = data[at + 1 : at + 2]
            if following in (b"\r", b"\n"):
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            out += ESCAPES.get(following, following)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
        at += 1
    return bytes(out)


def uris(content: bytes | None) -> list[str]:
    """URIs of the link annotations of a file, in order, each once."""
    found: dict[str, None] = {}
    for part in _inflated(bytes(content or b"")):
        for m in URI.finditer(part):
            if m[1] == b"(":
                raw = _literal(part, m.end())
            else:
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", part[m.end() : part.find(b">", m.end())])
                raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            text = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("utf-8", "replace")
            found.setdefault(text.strip(), None)
    return list(found)
