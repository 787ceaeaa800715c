from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from jobloom.llm import media
from tests.llm.fixtures import rows, table


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * ((-len(raw)) % 64 if raw else 64)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=3000))
def test_round_trip(text):
    raw = text.encode("utf-8", "ignore")
    got = media.unpack(media.pack(raw))
    assert got["payload"] == padded(raw) and got["n_bytes"] == len(raw)
    assert got["payload_ok"] and got["crc_bad"] == 0 and got["skipped"] == 0
    assert got["samples"] == 1152 * got["frames"] == 1152 * got["vbr"]["frames"]


def test_resync_skips_junk_and_reports_damage():
    raw = b"hello world " * 900
    m = bytearray(media.pack(raw))
    clean = media.unpack(bytes(m))
    at = clean["offsets"][2]
    junk = media.unpack(bytes(m[:at]) + b"\x00\xff\x00junk" + bytes(m[at:]))
    assert junk["skipped"] == 7 and junk["frames"] == clean["frames"] and junk["payload"] == clean["payload"]
    m[at + 10] ^= 1  # side information is under the checksum
    hurt = media.unpack(bytes(m))
    assert hurt["crc_bad"] == 1 and hurt["crc_good"] == clean["crc_good"] - 1


def test_seek_offsets_are_frames():
    m = media.pack(b"x" * 9000)
    got = media.unpack(m)
    assert all(media.parse_header(m[o : o + 4]) for o in got["offsets"])
    assert len(got["vbr"]["toc"]) == 100 and got["vbr"]["toc"] == sorted(got["vbr"]["toc"])


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"\xff\xfb" * 40, bytes(500)])
def test_streams_without_frames(data):
    got = media.unpack(data)
    assert got["frames"] == 0 and got["payload"] == b"" and got["samples"] == 0


def test_known_frame_sizes():
    assert media.parse_header(bytes.fromhex("fffb9000"))[:3] == (417, 1152, 44100)  # 128 kbit/s, 44.1 kHz
    assert media.parse_header(bytes.fromhex("fffb9200"))[0] == 418  # padded
    assert media.parse_header(bytes.fromhex("fff38000"))[:3] == (208, 576, 22050)  # MPEG-2, 64 kbit/s
    assert media.parse_header(bytes.fromhex("fffbf000")) is None and media.parse_header(bytes.fromhex("fffb9c00")) is None


def test_features_match_brute_force(spark):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.payload_ok) for r in media.media_features(table(spark)).collect())
    want = []
    for r in rows():
        raw = (r[1] or "").encode()
        p = padded(raw)
        want.append((r[0] if r[0] is not None else -1, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), True))
    assert got == sorted(want)
    assert media.media_features(table(spark, [])).count() == 0
