"""Bit arrays of a bounded size built by the executors, a segment a task at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 20


def probes(keys: np.ndarray, n_bits: int, k: int) -> list[np.ndarray]:
    """``k`` bit positions of each 64-bit key, by double hashing; ``n_bits`` is a power of two."""
    x = keys.view(np.uint64)
    step = (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)) | np.uint64(1)
    y = x ^ (x >> np.uint64(29))
    return [((y + np.uint64(i) * step) & np.uint64(n_bits - 1)).astype(np.int64) for i in range(k)]


def test(bits: np.ndarray, positions: np.ndarray) -> np.ndarray:
    return (bits[positions >> 3] >> (positions & 7).astype(np.uint8)) & 1 == 1


def build_bits(positions: DataFrame, n_bits: int) -> np.ndarray:
    """The bit array with all ``position`` values set; ``n_bits / 8`` bytes, whatever the rows."""
    segments = max(1, n_bits // SEGMENT)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for seg in np.unique(at // SEGMENT).tolist():
                own = have.setdefault(seg, np.zeros(SEGMENT, bool))
                own[at[at // SEGMENT == seg] % SEGMENT] = True
        for seg, own in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    parts = positions.select("position").repartition(min(segments, 64), F.expr(f"position div {SEGMENT}")).mapInArrow(fill, "segment long, bits binary")
    out = np.zeros(max(n_bits, SEGMENT) // 8, np.uint8)
    for row in parts.collect():
        out[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return out
