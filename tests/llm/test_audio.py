from __future__ import annotations

import random

import pytest

from groundcheck.llm import audio

FRAME = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)  # MPEG 1 layer III, 128 kbit/s, 44.1 kHz: 417 bytes


def brute(data: bytes) -> list[int]:
    """Offsets of frames by looking at every byte; for layer III at one rate without tags or tables."""

    def size(i: int) -> int:
        if i + 4 > len(data) or data[i] != 0xFF or data[i + 1] & 0xE0 != 0xE0:
            return 0
        version, layer, bits, rate = data[i + 1] >> 3 & 3, data[i + 1] >> 1 & 3, data[i + 2] >> 4, data[i + 2] >> 2 & 3
        if version == 1 or layer != 1 or bits in (0, 15) or rate == 3:
            return 0
        one = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
        two = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
        hz = [44100, 48000, 32000][rate] // {3: 1, 2: 2, 0: 4}[version]
        return (144 if version == 3 else 72) * (one if version == 3 else two)[bits] * 1000 // hz + (data[i + 2] >> 1 & 1)

    out, i, step = [], 0, False
    while i < len(data):
        n = size(i)
        if n and i + n <= len(data) and (step or i + n == len(data) or size(i + n)):
            out.append(i)
            i, step = i + n, True
        else:
            i, step = i + 1, False
    return out


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(FRAME if rng.random() < 0.7 else bytes(rng.randrange(0, 250) for _ in range(rng.randrange(1, 90))))
        data = b"".join(parts)
        got = audio.parse(data)
        assert got["offsets"] == brute(data)
        assert got["skipped_bytes"] == len(data) - 417 * len(got["offsets"])


def test_duration_is_exact():
    got = audio.parse(FRAME * 100)
    assert (got["n_frames"], got["samples"], got["sample_rate"], got["channels"], got["layer"], got["version"]) == (100, 115200, 44100, 2, 3, "1")
    assert got["duration_s"] == 115200 / 44100 and got["offsets"] == list(range(0, 41700, 417)) and got["resyncs"] == 0


def test_checksums():
    head = bytes([0xFF, 0xFA, 0x90, 0x00])
    body = bytes(range(200)) * 3
    good = head + audio.crc16(head[2:] + body[:32]).to_bytes(2, "big") + body[:411]
    bad = head + b"\0\0" + body[:411]
    got = audio.parse(good + bad + good)
    assert (got["crc_checked"], got["crc_failed"]) == (3, 1)
    assert audio.crc16(b"123456789") == 0xAEE7  # CRC-16 of this polynomial and start


def test_tags_and_tables():
    tag = b"ID3\x03\0\0\0\0\0\x13" + b"TIT2\0\0\0\x09\0\0\x01" + "abc".encode("utf-16")
    info = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"Xing" + (7).to_bytes(4, "big") + (2).to_bytes(4, "big") + (999).to_bytes(4, "big") + bytes(range(100))
    info += b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")
    old = b"TAG" + b"old".ljust(30, b"\0") + b"band".ljust(30, b"\0") + bytes(65)
    got = audio.parse(tag + info.ljust(417, b"\0") + FRAME * 2 + old)
    assert (got["title"], got["artist"], got["vbr"], got["table_frames"], got["table_bytes"]) == ("abc", "band", "Xing", 2, 999)
    assert got["toc"] == list(range(100)) and got["n_frames"] == 2 and got["samples"] == 2304 - 1576 and got["skipped_bytes"] == 0
    vbri = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(32) + b"VBRI" + bytes(6) + (500).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"\0\2\0\1\0\2\0\1" + b"\0\7\0\x09"
    got = audio.parse(vbri.ljust(417, b"\0") + FRAME)
    assert (got["vbr"], got["table_frames"], got["table_bytes"], got["toc"]) == ("VBRI", 3, 500, [7, 9])


@pytest.mark.parametrize("data", [b"", b"ID3", b"\xff", b"\xff\xfb\x90", b"ID3\x03\0\0\x7f\x7f\x7f\x7fxx", FRAME[:-1], b"TAG" + bytes(125), b"\xff" * 5000])
def test_broken_data_has_no_frame(data):
    got = audio.parse(data)
    assert got["n_frames"] == 0 and got["duration_s"] == 0.0 and got["offsets"] == []


def test_table(spark, odd, none):
    rows = audio.from_texts(odd).collect()
    assert len(rows) == 12 and sum(r["n_frames"] is None for r in rows) == 2
    one = [r for r in rows if r["doc_id"] == 1]
    assert one[0] == one[1] and one[0]["n_frames"] >= 1 and one[0]["title"].startswith("the house")
    assert audio.from_texts(none).collect() == []


def test_synthetic_streams_are_found_whole():
    seen = set()
    for key in range(200):
        text = f"word {key} " * (4000 if key % 2 else 90)
        data = audio.synthesise(text, key)
        got = audio.parse(data)
        n = got["n_frames"]
        seen.add((got["version"], got["layer"], got["vbr"]))
        assert got["title"] == text[:40] and n > 0
        if got["vbr"]:
            assert got["table_frames"] == n
        junk = b"junk\xff\xfe" * 3
        assert got["skipped_bytes"] == data.count(junk) * len(junk) and 0 <= (n - 1) // 41 - data.count(junk) <= 1
        if got["crc_checked"]:
            assert got["crc_failed"] == n // 29
        carried = b"".join(data[o : o + 4000] for o in got["offsets"])
        assert text.encode()[-20:] in carried
    assert {v for v, _, _ in seen} == {"1", "2", "2.5"} and {l for _, l, _ in seen} == {1, 2, 3} and {t for _, _, t in seen} == {None, "Xing", "VBRI"}


def test_streams_of_two_rates():
    other = bytes([0xFF, 0xFB, 0x94, 0x00]) + bytes(380)  # the same at 48 kHz: 384 bytes
    got = audio.parse(FRAME * 30 + other * 20)
    assert got["n_frames"] == 50 and got["skipped_bytes"] == 0 and got["resyncs"] == 0
    assert got["duration_s"] == pytest.approx(30 * 1152 / 44100 + 20 * 1152 / 48000) and got["sample_rate"] == 44100
    got = audio.parse(FRAME * 3 + b"junk" + other * 2)
    assert got["n_frames"] == 5 and got["skipped_bytes"] == 4
    assert audio.parse(FRAME * 3 + other)["n_frames"] == 3  # one frame of another rate is no agreement


def test_layer_one_joint_stereo_checksum():
    head = bytes([0xFF, 0xFE, 0x90, 0x60])  # layer I, protected, joint stereo with bound 12
    size = audio._HEADERS[head[1] << 10 | head[2] << 2 | head[3] >> 6][4]
    body = bytes(i * 7 % 256 for i in range(size))
    side = (32 + 12) // 2
    good = head + audio.crc16(head[2:] + body[:side]).to_bytes(2, "big") + body[: size - 6]
    bad = head + b"\1\1" + body[: size - 6]
    got = audio.parse(good + bad + good)
    assert (got["layer"], got["n_frames"], got["crc_checked"], got["crc_failed"]) == (1, 3, 3, 1)
