"""Helpers shared by the operators: byte-level NumPy kernels.

The kernels work on slices of an Arrow batch, a few hundred kilobytes of text
at a time, so a task's memory does not follow the size of its partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
BATCH_ROWS = 2000
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Gives free heap memory back to the system; only in GNU's C library.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as ''."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Two hashes that stand for a row's id and text; nulls count, so (t, null) and (null, t) differ."""
    one, two = F.col(id_col), F.col(text_col)
    return F.xxhash64(one.isNull(), one, two.isNull(), two), F.hash(two, two.isNull(), one, one.isNull())


# ---------------------------------------------------------------- batches


def in_small_batches(texts: DataFrame) -> DataFrame:
    """``texts``, to be handed to Python ``BATCH_ROWS`` rows at a time.

    Spark's default of 10,000 whole texts a batch takes tens of megabytes on
    both sides of each task.  Sets the session's limit, unless it is lower.
    """
    conf, name = texts.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return texts


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each, what Python holds unused goes back to the system.

    Workers live on between tasks, and Arrow's and C's allocators would keep
    the largest batch's memory, some 300 MB a worker.
    """
    for batch in batches:
        yield batch
        del batch
        give_back()


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function; once a task has its last batch, what Python holds unused goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Unused memory of Arrow and C goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def texts_of(column: pa.Array) -> pa.Array:
    """Text column of a batch, null as ''; a copy only if there are nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, offsets starting at 0."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if texts.buffers()[1] is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts in runs of about ``limit`` bytes: (first row, end row, bytes, offsets)."""
    data, off = byte_view(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x1000193))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    have = _powers.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SLICE_BYTES * 2)
        up, down = np.full(size, _P), np.full(size, _P_INV)
        up[0] = down[0] = 1
        have = _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


class Rolling:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_table(seed)[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        span = (end - start).astype(np.uint64)
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + span * np.uint64(0xD6E8FEB86659FD93))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word separators: space and the five ASCII controls of white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(data: np.ndarray, off: np.ndarray, is_sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of whole texts: (start, end, index of the text) of each, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~is_sep[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True  # words never cross texts
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(off, s, side="right") - 1


def hash_words(data: np.ndarray, off: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, index of its text)."""
    low = LOWER[data]
    s, e, doc = words_of(low, off)
    if not len(s):
        return np.zeros(0, np.uint64), doc
    return Rolling(low, seed).of(s, e), doc


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of equal-length hash columns."""
    out = np.full(len(parts[0]), 0x51ED270B, np.uint64)
    for p in parts:
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + p)
    return out


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (hashes ordered by text then hash, offsets by text).

    A text with fewer than ``width`` words has its whole sequence as its one
    shingle; one without words has none.
    """
    counts = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(counts)))
    out_h, out_d = [], []
    if len(words) >= width:
        same = doc[: len(doc) - width + 1] == doc[width - 1 :]
        h = combine([words[k : len(words) - width + 1 + k] for k in range(width)])
        out_h.append(h[same])
        out_d.append(doc[: len(h)][same])
    for size in range(1, width):
        at = np.flatnonzero(counts == size)
        if len(at):
            out_h.append(combine([words[first[at] + k] for k in range(size)]))
            out_d.append(at)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=n_docs))))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
