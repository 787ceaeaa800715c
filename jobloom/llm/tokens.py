"""Token-ID / binary output: independent zstandard frames with a seek table.

``write_tokens`` range-partitions documents by id, encodes each partition with
a public tokenizer and writes one file.  A file is a series of independent
zstandard frames, each holding the ids (little-endian unsigned 32 bit) of a
few whole documents; then a skippable frame with the document index; then a
skippable frame with the seek table: compressed size, size and checksum (low
32 bits of XXH64) of each frame, and a footer.  ``read_tokens`` reads whole
files or, with ``wanted``, decompresses only the frames of requested ids.

Defined results: a null or empty text has only the end id; repeated ids stay
in one file next to each other, each row with its own entry; a null id sorts
first, and so does -2**63, which stands for it in a file and reads as null; ids
are whole numbers (others raise Spark's cast error); very long texts are encoded
whole, in one frame; an empty table writes no file and reads as no rows; extra
columns are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm._shared import LOWER, byte_view, freed, in_small_batches, slices, texts_of
from jobloom.storage import scratch_path

#: Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME_BYTES = 1 << 18
FILE_BYTES = 48 << 20
#: Words that a worker remembers; some 150 bytes each, which it holds as long as it lives.
MEMO_WORDS = 200_000
NULL_ID = -(1 << 63)


#: Texts that an encoding by words must give the same ids for as one of whole texts.
PROBES = (
    "Plain words, and MORE of them.", " two  spaces\tand\n\nlines \r\n", "it's we'll DON'T o'clock 'quoted'", "a1b2 3.14 10,000 x=y+z", "Été naïve ß İ ﬁ e\u0301", "日本語 text 한국어 русский",
    "<|endoftext|> <b>x</b> a<b", "e-mail@host.org https://a.b/c?d=1#e", "## *bold* _it_ `code` ~~ $$$ ...", "CamelCase snake_case UPPER",
)


def _kinds(part: dict | None) -> set[str]:
    """The types of a tokenizer file's part and of those inside it."""
    if not part:
        return set()
    return {part.get("type")} | {k for x in part.get("normalizers", ()) for k in _kinds(x)}


class TokenFile(NamedTuple):
    path: str
    n_docs: int
    n_tokens: int


class WordEncoder:
    """Encodes texts by words between ASCII white space, each distinct word once.

    For a tokenizer that lower-cases, and whose pre-tokenizer splits at white
    space and between letters and punctuation, this gives the ids of encoding
    the whole text.  Whether one does is read from its file and tried on
    ``PROBES``; with any other, whole texts are encoded.  The memo is dropped
    when full.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tok, self.end = Tokenizer.from_file(path), end_id
        self.clear()
        self.by_word = True
        if "Lowercase" not in _kinds(json.loads(self.tok.to_str()).get("normalizer")):
            self.by_word = False
        else:
            ids, off = self.encode(pa.array(PROBES, pa.large_string()))
            self.by_word = all(ids[off[i] : off[i + 1] - 1].tolist() == self._whole(t) for i, t in enumerate(PROBES))
            self.clear()

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.memo, self.used = {"": 0}, 0
        self.pool, self.at, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if not new:
            return
        # a lower-case ASCII word is one pre-token and its own byte-level form: the library's BPE model takes it as it is
        plain = [w.isascii() and w.isalpha() and w.islower() for w in new]
        rest = iter(self.tok.encode_batch_fast([w for w, p in zip(new, plain, strict=True) if not p], add_special_tokens=False))
        bpe = self.tok.model.tokenize
        ids = [[t.id for t in bpe(w)] if p else next(rest).ids for w, p in zip(new, plain, strict=True)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.memo), int(sizes.sum())
        self.memo.update(zip(new, range(first, first + len(new)), strict=True))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while first + len(new) > len(self.at):
            self.at, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.sizes))
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.sizes[first : first + len(new)] = sizes
        self.at[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.used += total

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text), the end id behind each text."""
        if not self.by_word:
            ids = [[*self._whole(t), self.end] for t in texts.to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(off[-1])), off
        if len(self.memo) > MEMO_WORDS:
            self.clear()
        parts = pc.split_pattern(_loosened(texts), " ")
        codes = parts.flatten().dictionary_encode()
        words = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(words)
        which = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))[codes.indices.to_numpy(zero_copy_only=False)]
        n = self.sizes[which]
        ends = np.cumsum(n)
        bounds = np.concatenate(([0], ends))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.at[which] - (ends - n), n) + np.arange(total)]
        off = bounds + np.arange(len(bounds))
        out = np.empty(total + len(texts), np.uint32)
        own = np.ones(len(out), bool)
        own[off[1:] - 1] = False
        out[own], out[~own] = ids, self.end
        return out, off


def _loosened(texts: pa.Array) -> pa.Array:
    """The texts with ASCII letters lower-cased, newlines as spaces, and a space between a Latin letter and ASCII punctuation behind it.

    Apostrophes stay in their words, as contractions begin with them; texts with
    ``<|`` stay as they are, as special tokens begin with it.
    """
    data, off = byte_view(texts)
    if not len(data):
        return texts
    low = LOWER[data]
    low[low == 10] = 32
    letter = (low >= 97) & (low <= 122)
    letter[1:] |= (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] != 0x97) & (low[1:] != 0xB7)
    mark = _PUNCTUATION[low]
    mark[0] = False
    mark[1:] &= letter[:-1]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
    for r in np.unique(np.searchsorted(off, special, side="right") - 1):
        low[off[r] : off[r + 1]] = np.where(data[off[r] : off[r + 1]] == 10, 32, data[off[r] : off[r + 1]])
        mark[off[r] : off[r + 1]] = False
    at = np.flatnonzero(mark)
    shifted = off + np.searchsorted(at, off)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(shifted.astype(np.int64)), pa.py_buffer(np.insert(low, at, 32)))


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = True
_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder_for(path: str, end_id: int) -> WordEncoder:
    """The encoder of this Python worker; its memo serves one task after another."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


class FrameWriter:
    """Builds one file in memory of at most about ``FILE_BYTES`` of ids plus one document."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.seek, self.index, self.open, self.open_bytes = [], [], [], [], 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.index.append((doc_id, len(self.seek), self.open_bytes, len(ids)))
        self.open.append(ids.astype("<u4").tobytes())
        self.open_bytes += len(self.open[-1])
        if self.open_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.open:
            raw = b"".join(self.open)
            packed = self.zstd.compress(raw)
            self.frames.append(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.flush()
        index = np.array(self.index, np.int64).reshape(-1, 4).astype("<i8").tobytes()
        table = np.array(self.seek, np.int64).reshape(-1, 3).astype("<u4").tobytes() + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(table)), table])


class FrameReader:
    """Reads a file's tables, then only the frames asked for, verifying each."""

    def __init__(self, source):
        self.file, size = source, source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * n)
        self.seek = np.frombuffer(source.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.seek[:, 0])))
        source.seek(int(self.starts[-1]))
        kind, length = struct.unpack("<II", source.read(8))
        if kind != SKIPPABLE_INDEX:
            raise ValueError("no document index behind the frames")
        self.index = np.frombuffer(source.read(length), "<i8").reshape(-1, 4)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        self.file.seek(int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int, int, bytes]]:
        """(id, ids before it in this file, its ids) in file order."""
        before, have, raw = np.cumsum(self.index[:, 3]) - self.index[:, 3], -1, b""
        for (doc_id, k, at, n), start in zip(self.index.tolist(), before.tolist(), strict=True):
            if wanted is None or doc_id in wanted:
                if k != have:
                    have, raw = k, self.frame(k)
                yield doc_id, start, raw[at : at + 4 * n]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> list[TokenFile]:
    """Write token files below ``path`` in ascending id order; returns their manifest.

    The manifest has one entry a file, so what the driver holds is bounded by
    the number of files.  A retried task writes the same file again under a
    name of its own and renames it, so readers see whole files only.
    """
    spark = docs.sparkSession
    n = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        target, base = fs.FileSystem.from_uri(path)
        target.create_dir(base)
        encoder, writer, held, k, done = encoder_for(tokenizer, end_id), FrameWriter(), 0, 0, []

        def close() -> None:
            nonlocal writer, held, k
            name = f"{base}/part-{part:06d}-{k:04d}.zst"
            with target.open_output_stream(f"{name}.{attempt}") as out:
                out.write(writer.finish())
            target.move(f"{name}.{attempt}", name)
            done.append((part, k, f"part-{part:06d}-{k:04d}.zst", len(writer.index), sum(x[3] for x in writer.index)))
            writer, held, k = FrameWriter(), 0, k + 1

        for batch in freed(batches):
            doc_ids, texts = batch.column(0).fill_null(NULL_ID).to_pylist(), texts_of(batch.column(1))
            for i, j, _, _ in slices(texts, 4 << 20):
                ids, off = encoder.encode(texts.slice(i, j - i))
                for r in range(j - i):
                    writer.add(doc_ids[i + r], ids[off[r] : off[r + 1]])
                held += 4 * len(ids)
                if held >= FILE_BYTES:
                    close()
        if writer.index:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "k", "name", "n_docs", "n_tokens"), x, strict=True)) for x in done], schema=pa.schema([("part", pa.int64()), ("k", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))
    made = in_small_batches(sorted_rows).mapInArrow(encode, "part long, k long, name string, n_docs long, n_tokens long").collect()
    return [TokenFile(f"{path}/{r.name}", r.n_docs, r.n_tokens) for r in sorted(made, key=lambda r: (r.part, r.k))]


def read_tokens(spark: SparkSession, files: list[TokenFile], wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids): ``start`` counts the ids of all documents before it."""
    starts, only = np.cumsum([0, *(f.n_tokens for f in files)]).tolist(), None if wanted is None else set(wanted)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                source, name = fs.FileSystem.from_uri(path)
                with source.open_input_file(name) as f:
                    out: list[tuple[int, int, bytes]] = []
                    for doc_id, start, raw in FrameReader(f).documents(only):
                        out.append((doc_id, start + before, raw))
                        if len(out) == 512:
                            yield _rows(out)
                            out = []
                    if out:
                        yield _rows(out)

    # a row a file, so a task carries its own files' names only
    each = spark.createDataFrame([(k, f.path, starts[k]) for k, f in enumerate(files)], "k long, path string, before long")
    return each.repartitionByRange(max(1, len(files)), "k").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([None if x[0] == NULL_ID else x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([len(x[2]) // 4 for x in out], pa.int64()), pa.array([zlib.crc32(x[2]) for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())],
        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
    )


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents' ids, read the files back, digest each document."""
    spark = docs.sparkSession
    files = write_tokens(docs, scratch_path(spark, "tokens"), tokenizer, end_id)
    return read_tokens(spark, files).drop("ids")
