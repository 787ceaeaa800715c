"""WARC archives: round trips against a plain version, streams, damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random

import pytest

from jobloom.llm import warc
from jobloom.storage import scratch_path

SCHEMA = "page_id long, url string, html string, rec string, key int, place string, data binary"


def pages(n: int = 40) -> list[tuple]:
    rnd = random.Random(5)
    out = [(i, f"https://h{i % 3}.example/é?q={i}\r\nX: y", "<p>" + "é日x"[i % 3] * rnd.randint(0, 50)) for i in range(n)]
    out += [(100 + i, None, "same page") for i in range(30)] + [(90, "u", "same page"), (None, "v", "same page")]
    out += [(200, "u", None), (201, "u", ""), (202, None, None), (203, "w", "x" * 70_000), (204, "w", "x" * 70_000)]
    out += [(300, "a", "twice"), (300, "a", "twice"), (300, "b", "twice"), (301, "a", "twice"), (300, "a", "another text of that id")]
    return [*out, (None, None, "no id"), (None, "z", "no id"), (None, None, None)]


def plain(rows: list[tuple], least: int = 0) -> list[tuple]:
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    first: dict[bytes, int | None] = {}
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((t or "").encode(), i)
    out, met = [], set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        own = len(b) < least or b not in met
        met.add(b)
        out.append((i, len(b), sha(b), "response" if own else "revisit", None if own else first[b]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "r", 1, "p", b"d") for r in rows], SCHEMA).repartition(4)


def back(spark, files) -> list[tuple]:
    got = warc.read_records(spark, files).collect()
    whole = lambda x: None if x is None else int(x)
    return sorted(((whole(r.page), r.payload_bytes, r.payload_digest, r.record_type, whole(r.refers_to)) for r in got), key=repr)


@pytest.mark.parametrize("chunk", [1 << 14, 7])
def test_round_trip_equals_the_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rows = pages() if chunk > 7 else [r for r in pages() if len(r[2] or "") < 1000]
    assert sorted(map(tuple, warc.warc_digest(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_small_payloads_are_all_responses_and_files_roll(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    files = warc.write_warc(frame(spark, pages()), scratch_path(spark, "warc"), least=10)
    assert len(files) > 4
    assert sum(f.n_records for f in files) == len(pages())
    assert back(spark, files) == plain(pages(), least=10)


def test_hot_payloads_have_one_response(spark):
    rows = [(i, "u", "hot" if i % 3 else f"own {i}") for i in range(3000, 0, -1)]
    assert sorted(map(tuple, warc.warc_digest(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_archives_are_plain_gzip_of_warc_and_read_as_chunk_rows(spark):
    files = warc.write_warc(frame(spark, pages()), scratch_path(spark, "warc"))
    chunks = warc.read_warc(spark, files).collect()
    assert max(len(r.data) for r in chunks) <= warc.CHUNK
    assert {r.chunk_no for r in chunks} == set(range(-(-70_000 // warc.CHUNK)))
    whole: dict[tuple, bytes] = {}
    for r in sorted(chunks, key=lambda r: (r.path, r.record, r.chunk_no)):
        whole[r.path, r.record] = whole.get((r.path, r.record), b"") + r.data
    heads = {(r.path, r.record): r.fields for r in chunks if r.chunk_no == 0}
    assert sorted(whole[k].decode() for k in whole if heads[k]["warc-type"] == "response") == sorted({t or "" for _, _, t in pages()})
    raw = gzip.decompress(open(files[0].path.removeprefix("file://"), "rb").read())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert b"\r\nX: y" not in raw  # a URL cannot add fields to a head
    named = {f["warc-record-id"]: f for f in heads.values()}
    assert len(named) == len(heads)
    for f in heads.values():
        if f["warc-type"] == "revisit":
            assert named[f["warc-refers-to"]]["warc-type"] == "response"
            assert f["warc-refers-to-target-uri"] == named[f["warc-refers-to"]]["warc-target-uri"]


def test_empty_tables_and_text_ids(spark):
    empty = frame(spark, pages()).limit(0)
    assert warc.warc_digest(empty).collect() == []
    named = spark.createDataFrame([("a/1\n", "u", "x"), ("b", "u", "x")], "page_id string, url string, html string")
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.warc_digest(named).collect()) == [("a/1\n", "response", None), ("b", "revisit", "a/1\n")]


def test_damage_is_noticed(spark):
    files = warc.write_warc(frame(spark, [(1, "u", "payload text")]), scratch_path(spark, "warc"))
    path = files[0].path.removeprefix("file://")
    raw = gzip.decompress(open(path, "rb").read())
    with open(path, "wb") as f:
        f.write(gzip.compress(raw.replace(b"payload text", b"payl0ad text")))
    with pytest.raises(Exception, match="digest of record"):
        warc.read_records(spark, files).collect()
    with pytest.raises(ValueError, match="ends inside"):
        for _, _, chunks in warc.ArchiveReader(io.BytesIO(gzip.compress(raw[:-12]))).records():
            list(chunks)
