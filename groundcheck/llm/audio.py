"""MPEG audio columns: frames, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

``parse`` walks a byte string frame by frame. A header is taken where a compatible header, the end or a trailing tag
follows its frame; otherwise the reader looks for the next one (a resynchronisation). A stream can go over to another
version, layer or sample rate, where two frames in a row agree on it. MPEG 1, 2 and 2.5, layers I to III; free-format
frames are not frames. CRC-16 is checked where the length of the protected bits is known from the header, in layers I and
III. The duration is the sum of samples over the sample rate that they were sent at; encoder delay and padding that a
Xing or Info table states are taken off (a VBRI table's delay is not, players differ on it). ``sample_rate`` is the
first frame's.

Defined cases: null bytes give a row of nulls; empty bytes and bytes without a frame give zero frames, duration 0 and
no offsets; a frame that the data cut short is not a frame; broken tags are skipped as junk; rows with a null doc_id are
parsed like others; repeated rows give repeated rows; further columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 3: (11025, 12000, 8000)}  # 3 stands for 2.5
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
KBPS[2, 3] = KBPS[2, 2]
SCHEMA = (
    "doc_id bigint, title string, artist string, version string, layer int, sample_rate int, channels int, n_frames bigint, "
    "samples bigint, duration_s double, vbr string, table_frames bigint, table_bytes bigint, toc array<int>, crc_checked bigint, "
    "crc_failed bigint, resyncs bigint, skipped_bytes bigint, offsets array<bigint>"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")][1:]


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        r = byte << 8
        for _ in range(8):
            r = (r << 1 ^ 0x8005 if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for byte in data:
        crc = (crc << 8 & 0xFF00) ^ _CRC[crc >> 8 ^ byte]
    return crc


def _headers() -> dict[int, tuple[int, int, int, int, int, int, int, bool, int]]:
    """Every valid value of the second to fourth header byte, without the bits that do not matter for framing, to
    (version, layer, rate, channels, frame bytes, samples, side bytes, protected, family)."""
    found = {}
    for second in range(0xE0, 0x100):
        version, layer = {3: 1, 2: 2, 0: 3}.get(second >> 3 & 3, 0), 4 - (second >> 1 & 3)
        if not version or layer == 4:
            continue
        for third in range(256):
            kbps, rate = third >> 4, third >> 2 & 3
            if kbps in (0, 15) or rate == 3:
                continue
            hz, bps, pad = RATES[version][rate], KBPS[min(version, 2), layer][kbps - 1] * 1000, third >> 1 & 1
            if layer == 1:
                size, samples = (12 * bps // hz + pad) * 4, 384
            else:
                samples = 576 if layer == 3 and version > 1 else 1152
                size = samples // 8 * bps // hz + pad
            for mode in range(4):
                mono = mode == 3
                if layer == 3:
                    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
                else:
                    side = (16 if mono else 32) if layer == 1 and mode != 1 else 0
                found[second << 10 | third << 2 | mode] = (version, layer, hz, 2 - mono, size, samples, side, not second & 1, second >> 1 << 2 | rate)
    return found


_HEADERS = _headers()


def _text(raw: bytes) -> str:
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0], "latin-1") if raw else "latin-1"
    return raw[1:].decode(kind, "replace").split("\0")[0]


def id3v2(data: bytes, at: int = 0) -> tuple[int, dict[str, str]]:
    """Length of the tag at ``at`` (0 where there is none) and its text frames."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(b & 0x80 for b in data[at + 6 : at + 10]) or data[at + 3] == 0xFF:
        return 0, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    version, flags, size = data[at + 3], data[at + 5], safe(data[at + 6 : at + 10])
    body, texts = data[at + 10 : at + 10 + size], {}
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    i = 0
    if flags & 0x40 and len(body) >= 4:
        i = safe(body[:4]) if version >= 4 else struct.unpack(">I", body[:4])[0] + 4
    wide = version >= 3
    while i + (10 if wide else 6) <= len(body) and body[i]:
        name = body[i : i + (4 if wide else 3)].decode("latin-1")
        if wide:
            n = safe(body[i + 4 : i + 8]) if version >= 4 else struct.unpack(">I", body[i + 4 : i + 8])[0]
            i += 10
        else:
            n = int.from_bytes(body[i + 3 : i + 6], "big")
            i += 6
        if n <= 0 or i + n > len(body):
            break
        if name[0] == "T" and name[:2] != "TX":
            texts.setdefault({"TT2": "TIT2", "TP1": "TPE1"}.get(name, name), _text(body[i : i + n]))
        i += n
    return min(10 + size + (10 if flags & 0x10 and version >= 4 else 0), len(data) - at), texts


def vbr_table(frame: bytes, side: int) -> dict | None:
    """What a Xing, Info or VBRI table in a first frame says."""
    for at in (4 + side, 6 + side):
        name = frame[at : at + 4]
        if name in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, i = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
            got: dict = {"vbr": name.decode(), "table_frames": None, "table_bytes": None, "toc": None, "trim": 0}
            for bit, key in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit and i + 4 <= len(frame):
                    got[key] = struct.unpack(">I", frame[i : i + 4])[0]
                    i += 4
            if flags & 4 and i + 100 <= len(frame):
                got["toc"] = list(frame[i : i + 100])
                i += 100
            i += 4 if flags & 8 else 0
            if frame[i : i + 4] in (b"LAME", b"Lavf", b"Lavc") and i + 24 <= len(frame):
                delay = int.from_bytes(frame[i + 21 : i + 24], "big")
                got["trim"] = (delay >> 12) + (delay & 0xFFF)
            return got
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62])
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"vbr": "VBRI", "table_frames": frames, "table_bytes": size, "toc": toc, "trim": 0}
    return None


def parse(data: bytes | None) -> dict:
    """All fields of ``SCHEMA`` but doc_id."""
    out: dict = dict.fromkeys(FIELDS)
    if data is None:
        return out
    out |= {"n_frames": 0, "samples": 0, "duration_s": 0.0, "crc_checked": 0, "crc_failed": 0, "resyncs": 0, "skipped_bytes": 0, "offsets": []}
    at, end, tags = 0, len(data), {}
    while (n := id3v2(data, at)[0]) > 0:
        tags |= {k: v for k, v in id3v2(data, at)[1].items() if k not in tags}
        at += n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        old = data[end : end + 128]
        for key, part in (("TIT2", old[3:33]), ("TPE1", old[33:63])):
            tags.setdefault(key, part.split(b"\0")[0].decode("latin-1").rstrip())
    out |= {"title": tags.get("TIT2"), "artist": tags.get("TPE1")}

    def header(i: int) -> tuple | None:
        if i + 4 > end or data[i] != 0xFF:
            return None
        return _HEADERS.get(data[i + 1] << 10 | data[i + 2] << 2 | data[i + 3] >> 6)

    family, lost, trim, first, offsets = None, at, 0, True, out["offsets"]
    samples: dict[int, int] = {}
    while at < end:
        h = header(at)
        ok = h is not None and at + h[4] <= end
        if ok and (family is None or lost != at or h[8] != family):  # not in step: the frame after it must agree
            after = header(at + h[4])
            ok = after is not None and after[8] == h[8] or at + h[4] == end and family in (None, h[8])
        if not ok:
            at = data.find(b"\xff", at + 1, end)
            if at < 0:
                at = end
            continue
        if lost != at:
            out["resyncs"] += bool(offsets) or family is not None
            out["skipped_bytes"] += at - lost
        version, layer, hz, channels, size, count, side, protected, family = h
        if layer == 1 and data[at + 3] >> 6 == 1:  # joint stereo: one allocation for both channels from the bound on
            side = (36 + 4 * (data[at + 3] >> 4 & 3)) // 2
        if protected and side:
            out["crc_checked"] += 1
            out["crc_failed"] += crc16(data[at + 6 : at + 6 + side], crc16(data[at + 2 : at + 4])) != data[at + 4] << 8 | data[at + 5]
        table = vbr_table(data[at : at + size], side) if first and layer == 3 else None
        if first:
            out |= {"version": {1: "1", 2: "2", 3: "2.5"}[version], "layer": layer, "sample_rate": hz, "channels": channels}
        if table:
            trim = table.pop("trim")
            out |= table
        else:
            offsets.append(at)
            samples[hz] = samples.get(hz, 0) + count
        first = False
        at += size
        lost = at
    out["skipped_bytes"] += end - lost
    if out["sample_rate"] in samples:
        samples[out["sample_rate"]] = max(0, samples[out["sample_rate"]] - trim)
    out |= {"n_frames": len(offsets), "samples": sum(samples.values()), "duration_s": sum(n / hz for hz, n in samples.items())}
    return out


def synthesise(text: str | None, key: object) -> bytes | None:
    """An MPEG stream that carries the bytes of ``text`` as frame payload; for tables without audio.

    The key's hash sets version, layer, rate, channels, protection, bitrates, tags and table, and whether a long stream
    goes over to another rate halfway. Every 29th frame has a wrong checksum, and junk stands before every 41st.
    """
    if text is None:
        return None
    raw = text.encode("utf-8", "surrogatepass")
    h = xxhash.xxh3_64_intdigest(f"{key}:{len(raw)}")
    version, rate, mono, protect, variable = 1 + h % 3, h >> 8 & 1, h >> 9 & 1, h >> 10 & 1, h >> 11 & 1
    layer = (3, 3, 2, 1)[h >> 12 & 3]
    second = 0xE0 | {1: 3, 2: 2, 3: 0}[version] << 3 | (4 - layer) << 1 | (not protect)
    name = text[: 40].encode("utf-8", "surrogatepass")
    body = b"TIT2" + struct.pack(">IH", len(name) + 1, 0) + b"\x03" + name + b"TPE1" + struct.pack(">IH", 5, 0) + b"\x00" + f"{h % 9999:04d}".encode()
    size = len(body)
    out = [b"ID3\x03\x00\x00" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body]

    def frame(kbps: int, hz: int, payload: bytes, at: int, wrong: bool) -> tuple[bytes, int]:
        third, fourth = kbps << 4 | hz << 2, (3 if mono else 0) << 6
        size, side = _HEADERS[second << 10 | third << 2 | fourth >> 6][4], _HEADERS[second << 10 | third << 2 | fourth >> 6][6]
        inner = size - 4 - 2 * protect
        part = payload[at : at + inner].ljust(inner, b"\0")
        check = struct.pack(">H", crc16(part[:side], crc16(bytes([third, fourth]))) ^ wrong) if protect else b""
        return bytes([0xFF, second, third, fourth]) + check + part, inner

    rates = [9, 7, 11, 5] if variable else [9]
    frames, at, k, other, since = [], 0, 0, h >> 14 & 1 and len(raw) > 20_000, 0
    while at < len(raw):
        moved = other and at > len(raw) // 2
        made, inner = frame(rates[k % len(rates)], 2 if moved else rate, raw, at, k % 29 == 28)
        frames.append((b"junk\xff\xfe" * 3 if k % 41 == 40 and since != 1 else b"") + made)  # two frames tell of a new rate
        at, k, since = at + inner, k + 1, since + moved
    if variable and frames and layer == 3:
        side = _HEADERS[second << 10 | (9 << 4 | rate << 2) << 2 | (3 if mono else 0)][6]
        total = sum(map(len, frames))
        if h >> 15 & 1:
            table = (b"VBRI" + bytes(6) + struct.pack(">IIHHHH", total, k, 2, 1, 2, 1) + b"\0\1\0\2").rjust(32 + 30 - 2 * protect, b"\0")
        else:
            table = bytes(side) + b"Xing" + struct.pack(">III", 7, k, total) + bytes(i * 255 // 99 for i in range(100))
        if len(frame(9, rate, b"", 0, False)[0]) > len(table) + 6:
            out.append(frame(9, rate, table, 0, False)[0])
    out += frames
    if h >> 5 & 1:
        out.append(b"TAG" + b"old title".ljust(30, b"\0") + b"old artist".ljust(30, b"\0") + bytes(65))
    return b"".join(out)


def parsed(clips: DataFrame, key: str = "doc_id", audio: str = "audio") -> DataFrame:
    """One row of audio columns for each clip; one narrow stage without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([parse(None if x is None else bytes(x)) for x in pdf["audio"]], columns=FIELDS, dtype=object)
            got.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield got

    return map_slices(clips.select(clips[key].cast("bigint").alias("doc_id"), clips[audio].alias("audio")), run, SCHEMA)


def from_texts(docs: DataFrame) -> DataFrame:
    """Audio columns of streams that carry the documents' texts: the tables have no audio of their own."""

    @F.pandas_udf("binary")
    def stream(key: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([synthesise(t, k) for k, t in zip(key.fillna(""), text)], dtype=object)

    return parsed(docs.select(docs["doc_id"].alias("doc_id"), stream(docs["doc_id"].cast("string"), docs["text"]).alias("audio")))
