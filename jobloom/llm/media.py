"""Media columns: MPEG audio.

``write_mpeg`` wraps a binary or text column as an MPEG-1 Layer III stream: an
ID3v2 tag, a Xing frame with the variable-bitrate table, CRC-protected mono
frames whose granules are silent and whose ancillary bytes carry the payload,
and an ID3v1 tag.  ``parse_mpeg`` reads any MPEG-1/2/2.5 stream: it skips and
parses tags, resynchronises on frame headers, verifies each protected frame's
CRC-16, reads the Xing or VBRI table and returns exact sample counts and the
byte offset of each seek point.

Defined results: a null value is the empty payload; an empty payload still has
one 64-byte unit of zeros; a stream without any frame has 0 frames, 0 samples
and an empty payload; repeated rows give repeated results; columns other than
the id and the value are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import in_small_batches
from jobloom.storage import materialize

UNIT = 64
# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by table and index, Hz by version.
V1_L1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
V1_L2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
V1_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
V2_L1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
V2_L23 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLY = 0x8005

RATE_32K = 2
SIDE_MONO = 17
HEAD = 4 + 2 + SIDE_MONO
SEEK_POINTS = 100


def _crc_table() -> tuple[int, ...]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return tuple(table)


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """MPEG frame checksum over the last two header bytes and the side information."""
    crc = 0xFFFF
    for byte in data:
        crc = (crc << 8) & 0xFFFF ^ _TABLE[crc >> 8 ^ byte]
    return crc


@lru_cache(maxsize=64)
def _frame_head(index: int) -> bytes:
    """Header, checksum and silent side information of a mono 32 kHz frame."""
    header = bytes((0xFF, 0xFA, index << 4 | RATE_32K << 2, 0xC0))
    side = bytes(SIDE_MONO)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


@lru_cache(maxsize=4096)
def parse_header(word: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """(frame bytes, samples, rate, side bytes, layer, protected), or None if it is no header."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    rate_i, bit_i = word[2] >> 2 & 3, word[2] >> 4
    if version == 1 or layer == 4 or rate_i == 3 or bit_i in (0, 15):
        return None
    table = {1: V1_L1, 2: V1_L2, 3: V1_L3}[layer] if version == 3 else (V2_L1 if layer == 1 else V2_L23)
    kbps, rate, pad = table[bit_i], RATES[version][rate_i], word[2] >> 1 & 1
    mono = word[3] >> 6 == 3
    if layer == 1:
        return (12 * kbps * 1000 // rate + pad) * 4, 384, rate, 0, 1, not word[1] & 1
    samples = 576 if layer == 3 and version != 3 else 1152
    side = 0 if layer == 2 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return samples // 8 * kbps * 1000 // rate + pad, samples, rate, side, layer, not word[1] & 1


_SIZES = [144 * k * 1000 // 32000 for k in V1_L3]


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def _text_frame(name: bytes, text: str) -> bytes:
    body = b"\0" + text.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def pack(raw: bytes) -> bytes:
    """The MPEG stream that carries ``raw``, padded with zeros to a positive multiple of 64."""
    payload = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
    frames, at, most = [], 0, _SIZES[14] - HEAD
    while at < len(payload):
        left = len(payload) - at
        index = 14 if left >= most else next(i for i in range(1, 15) if _SIZES[i] - HEAD >= left)
        body = payload[at : at + _SIZES[index] - HEAD]
        frames.append(_frame_head(index) + body + bytes(_SIZES[index] - HEAD - len(body)))
        at += len(body)
    audio = sum(map(len, frames))
    first = _SIZES[1]
    ends = np.cumsum([first, *map(len, frames)])
    points = ends[np.arange(SEEK_POINTS) * len(frames) // SEEK_POINTS]
    toc = (points * 255 // (first + audio)).astype(np.uint8).tobytes()
    xing = b"Xing" + struct.pack(">III", 7, len(frames), first + audio) + toc
    head = (_frame_head(1) + xing).ljust(first, b"\0")
    millis = len(frames) * 1152 * 1000 // 32000
    tags = _text_frame(b"TLEN", str(millis)) + _text_frame(b"TXXX", f"payload\0{len(raw)}:{len(payload)}:{zlib.crc32(payload)}")
    old = b"TAG" + b"payload".ljust(30, b"\0") + bytes(95)
    return b"ID3\3\0\0" + _syncsafe(len(tags)) + tags + head + b"".join(frames) + old


def _read_tags(data: bytes) -> tuple[int, dict[str, str]]:
    """(first byte behind the ID3v2 tags, their text frames)."""
    at, tags = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        b = data[at + 6 : at + 10]
        end = min(len(data), at + 10 + (b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]))
        p, four = at + 10, data[at + 3] >= 4
        if data[at + 5] & 0x40 and p + 4 <= end:  # extended header
            n = int.from_bytes(data[p : p + 4], "big")
            p += n if four else n + 4
        while p + 10 <= end and data[p] != 0:
            s = data[p + 4 : p + 8]
            size = s[0] << 21 | s[1] << 14 | s[2] << 7 | s[3] if four else int.from_bytes(s, "big")
            if data[p : p + 1] == b"T" and size:
                name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : p + 10 + size]
                text = body[1:].decode("utf-16" if body[0] == 1 else "utf-16-be" if body[0] == 2 else "utf-8" if body[0] == 3 else "latin-1", "replace")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value.rstrip("\0")
            p += 10 + size
        at = end
    return at, tags


def _read_vbr(data: bytes, at: int, side: int, protected: bool) -> dict | None:
    """The Xing, Info or VBRI table of the frame at ``at``."""
    p = at + 4 + 2 * protected + side
    kind = data[p : p + 4]
    if kind in (b"Xing", b"Info") and len(data) >= p + 8:
        flags, p, out = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        _, _, _, size, frames, entries, scale, width, _ = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        raw = data[p + 26 : p + 26 + entries * width]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw), max(width, 1))]}
    return None


def unpack(data: bytes) -> dict:
    """Everything ``parse_mpeg`` stores about one stream."""
    at, tags = _read_tags(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) >= at + 128 else len(data)
    vbr, offsets, bodies, samples, rate, good, bad, skipped = None, [], [], 0, 0, 0, 0, 0
    locked = first = False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        whole = h is not None and at + h[0] <= end
        # after a loss of sync, a header counts only if the next one follows it, or the stream ends there
        if whole and not locked:
            whole = at + h[0] == end or parse_header(data[at + h[0] : at + h[0] + 4]) is not None
        if not whole:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped, at, locked = skipped + nxt - at, nxt, False
            continue
        size, n, rate, side, layer, protected = h
        locked = True
        body = at + 4 + 2 * protected + side
        if protected and layer == 3:
            ok = int.from_bytes(data[at + 4 : at + 6], "big") == crc16(data[at + 2 : at + 4] + data[at + 6 : body])
            good, bad = good + ok, bad + (not ok)
        if not first and (vbr := _read_vbr(data, at, side, protected)):
            first = True
        else:
            first = True
            offsets.append(at)
            samples += n
            bodies.append(data[body : at + size])
        at += size
    skipped += max(0, end - at)
    carried = b"".join(bodies)
    note = tags.get("payload", "").split(":")
    raw, size, crc = map(int, note) if len(note) == 3 and all(x.isdigit() for x in note) else (len(carried), len(carried), None)
    payload = carried[:size]
    return {
        "tags": tags, "vbr": vbr, "frames": len(offsets), "samples": samples, "rate": rate, "offsets": offsets, "crc_good": good,
        "crc_bad": bad, "skipped": skipped, "payload": payload, "n_bytes": raw, "payload_ok": crc is None or zlib.crc32(payload) == crc,
    }


def write_mpeg(df: DataFrame, id_col: str = "doc_id", value_col: str = "text") -> DataFrame:
    """(id, media): each value's bytes as an MPEG stream."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            for i in range(0, len(values), 256):
                part = values.slice(i, 256)
                yield pa.RecordBatch.from_arrays([ids.slice(i, 256), pa.array([pack(v or b"") for v in part.to_pylist()], pa.binary())], ["id", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(value_col).cast("binary").alias("value"))
    return in_small_batches(rows).mapInArrow(encode, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def parse_mpeg(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a stream: tags, table, exact duration, seek offsets, checks and the payload read back."""
    fields = "media_bytes long, media_sha256 string, n_frames long, n_samples long, sample_rate int, seek_offsets array<long>, toc array<long>, tags map<string,string>, crc_good long, crc_bad long, skipped_bytes long, n_bytes long, payload_ok boolean, payload binary"
    kind = df.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = batch.column(0), batch.column(1)
            for i in range(0, len(media), 256):
                raw = [m or b"" for m in media.slice(i, 256).to_pylist()]
                got = [unpack(m) for m in raw]
                cols = [
                    ids.slice(i, 256), pa.array(map(len, raw), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in raw]),
                    *(pa.array([g[k] for g in got], t) for k, t in (("frames", pa.int64()), ("samples", pa.int64()), ("rate", pa.int32()), ("offsets", pa.list_(pa.int64())))),
                    pa.array([(g["vbr"] or {}).get("toc") for g in got], pa.list_(pa.int64())), pa.array([list(g["tags"].items()) for g in got], pa.map_(pa.string(), pa.string())),
                    *(pa.array([g[k] for g in got], t) for k, t in (("crc_good", pa.int64()), ("crc_bad", pa.int64()), ("skipped", pa.int64()), ("n_bytes", pa.int64()), ("payload_ok", pa.bool_()), ("payload", pa.binary()))),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["id", *(f.split(" ")[0] for f in fields.split(", "))])

    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return in_small_batches(rows).mapInArrow(decode, f"id {kind}, {fields}").withColumnRenamed("id", id_col)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an audio column in the shared folder, read it back, digest it."""
    stored = materialize(write_mpeg(docs, id_col, text_col), "media")
    got = parse_mpeg(stored, id_col, "media")
    micros = F.expr("n_samples * 1000000L div greatest(sample_rate, 1)")
    return got.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.concat_ws(":", "n_frames", "n_samples", "sample_rate", micros, "crc_good", "crc_bad", "skipped_bytes", "payload_ok", F.element_at("seek_offsets", -1)).alias("feature"),
        "n_frames",
        micros.alias("duration_us"),
        "payload_ok",
    )
