"""Exact removal of repeated byte strings by a sparse, range-partitioned suffix sort.

A byte is removed if a string of ``LENGTH`` bytes that covers it starts
anywhere else too.  Not every suffix is sorted: each window of ``LENGTH`` bytes
has an anchor, the start of its least ``GRAM``-byte hash, which depends on the
window's bytes alone, so equal windows have their anchors at the same place.
Windows with one anchor form a run, about one for each hundred bytes of text.

1. One row a run: the leading bytes of the suffix at its anchor, a digest of
   the whole run, its place.  Rows are range-partitioned and sorted by leading
   bytes, digest and place: Spark samples the splitters, and as places are
   unique, a string that occurs in a third of all rows is spread over many
   partitions.
2. Each partition compares neighbours.  Runs that equal a neighbour are
   repeated as a whole.  A run whose suffix begins like that of a different
   run, or stands at a partition's boundary, is open.
3. Of open runs (one for each different content), all windows are digested,
   range-partitioned, sorted and compared in the same way; the rows at
   boundaries, two a partition, are compared across them.
4. The repeated places of each document are joined with its text.

The order within a partition comes from Spark's own sort, not from multikey
quicksort: both give the same neighbours.

Defined results: a null text is empty; a text shorter than ``LENGTH`` keeps
all bytes; rows with equal id and text count as places of their own, so they
repeat each other, also where a boundary falls between them; very long texts
are taken whole; an empty table gives no rows; matches never cross texts; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import Rolling, mix64, row_keys, slices, texts_of
from jobloom.llm.bits import build_bits, test
from jobloom.storage import materialize

LENGTH = 200
GRAM = 64
BLOOM_BITS = 1 << 26
RUN = "lead long, digest long, key long, key2 int, row long, at int, span int"
PLACE = "key long, key2 int, at int, span int"


def runs_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(leading bytes, digest, text, place, length) of the runs of whole texts."""
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    first = Rolling(data, 3)
    h = mix64((first.sums[GRAM:] - first.sums[:-GRAM]) * first.down[: n - GRAM + 1])
    bits = max(20, int(n).bit_length())
    low = np.uint64((1 << bits) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: -(width - have)], m[width - have :])
    anchor = (m & low).astype(np.int64)
    long = np.flatnonzero(np.diff(off) >= LENGTH)
    step = np.zeros(len(anchor) + 1, np.int8)
    step[off[long]] += 1
    step[off[long + 1] - LENGTH + 1] -= 1
    valid = np.cumsum(step[:-1], dtype=np.int8) > 0
    turn = np.flatnonzero(anchor[1:] != anchor[:-1])
    start, end = valid.copy(), valid.copy()
    start[1:] &= ~valid[:-1]
    end[:-1] &= ~valid[1:]
    start[turn + 1] = valid[turn + 1]
    end[turn] = valid[turn]
    lo, hi = np.flatnonzero(start), np.flatnonzero(end)
    a = anchor[lo]
    lead = np.zeros(len(a), np.uint64)
    for k in range(4):
        lead = lead << np.uint64(8) | data[a + k].astype(np.uint64)
    lead = lead << np.uint64(32) | (h[a] & np.uint64(0xFFFFFFFF))
    text = np.searchsorted(off, lo, side="right") - 1
    return lead.view(np.int64), Rolling(data, 4).of(lo, hi + LENGTH).view(np.int64), text, lo - off[text], hi - lo + LENGTH


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    key, key2 = row_keys(id_col, text_col)
    return key.alias("key"), key2.alias("key2")


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    """A partition's columns; range partitions by unique keys are of bounded size."""
    parts = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(k).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64) for k in range(n)]


def sorted_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The runs of all texts, range-partitioned by leading bytes and sorted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            for i, _, data, off in slices(texts_of(batch.column(3))):
                lead, digest, text, at, span = runs_of(data, off)
                yield pa.RecordBatch.from_arrays([pa.array(lead), pa.array(digest), *(pa.array(k[i + text]) for k in keys), pa.array(at.astype(np.int32)), pa.array(span.astype(np.int32))], ["lead", "digest", "key", "key2", "row", "at", "span"])

    # the row number only tells equal rows apart while sorting; nothing is joined by it
    rows = docs.select(*_keys(id_col, text_col), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    order = ["lead", "digest", "key", "row", "at"]
    return rows.mapInArrow(scan, RUN).repartitionByRange(*order).sortWithinPartitions(*order)


def compared_runs(runs: DataFrame) -> DataFrame:
    """(place, repeated, open): runs that equal another, and those whose windows need a look."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, digest, key, key2, at, span = _whole(batches, 6)
        if not len(lead):
            return
        other = np.concatenate(([True], lead[1:] != lead[:-1]))
        new = other | np.concatenate(([True], digest[1:] != digest[:-1]))
        block = np.cumsum(new) - 1
        size = np.bincount(block)
        repeated = size[block] > 1
        group = np.cumsum(other) - 1
        mixed = np.bincount(group, new) > 1
        mixed[[0, -1]] = True  # what lies beyond the boundary is not known here
        open_ = new & mixed[group]
        use = repeated | open_
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (key, key2.astype(np.int32), at.astype(np.int32), span.astype(np.int32), repeated, open_)], ["key", "key2", "at", "span", "repeated", "open"])

    return runs.select("lead", "digest", "key", "key2", "at", "span").mapInArrow(compare, f"{PLACE}, repeated boolean, open boolean")


def _filtered(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, others: bool = False) -> DataFrame:
    """(key, key2, id, text) of the rows whose key may be among ``keys``, or is certainly not.

    A Bloom filter of bounded size: an exact join follows, and fewer texts
    have to be shuffled for it.
    """

    def spots(key: Column) -> list[Column]:
        return [F.pmod(key, F.lit(BLOOM_BITS)), F.pmod(F.shiftright(key, 31), F.lit(BLOOM_BITS))]

    bits = docs.sparkSession.sparkContext.broadcast(build_bits(keys.select(F.explode(F.array(*spots(F.col("key")))).alias("position")), BLOOM_BITS))
    kind = docs.schema[id_col].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = test(bits.value, batch.column(4).to_numpy()) & test(bits.value, batch.column(5).to_numpy())
            yield batch.select([0, 1, 2, 3]).filter(pa.array(found != others))

    key, key2 = _keys(id_col, text_col)
    rows = docs.select(key, key2, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    p, q = spots(F.col("key"))
    return rows.withColumns({"p": p, "q": q}).mapInArrow(keep, f"key long, key2 int, id {kind}, text string")


def open_windows(docs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(w1, w2, key, key2, at): digests of all windows of the open runs, sorted."""
    by_doc = places.groupBy("key", "key2").agg(F.collect_set(F.struct("at", "span")).alias("runs"))
    texts = _filtered(docs, places, id_col, text_col).dropDuplicates(["key", "key2"]).join(by_doc, ["key", "key2"]).select("key", "key2", "text", "runs.at", "runs.span")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, key2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, data, off in slices(texts_of(batch.column(2))):
                at, span = batch.column(3).slice(i, j - i), batch.column(4).slice(i, j - i)
                text = np.repeat(np.arange(j - i), np.diff(at.offsets.to_numpy()))
                start, count = at.flatten().to_numpy() + off[text], span.flatten().to_numpy() - LENGTH + 1
                p = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
                text = np.repeat(text, count)
                w1, w2 = (Rolling(data, seed).of(p, p + LENGTH).view(np.int64) for seed in (5, 6))
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array((w2 & 0x7FFFFFFF).astype(np.int32)), pa.array(key[i + text]), pa.array(key2[i + text]), pa.array((p - off[text]).astype(np.int32))], ["w1", "w2", "key", "key2", "at"])

    order = ["w1", "w2", "key", "at"]
    return texts.mapInArrow(digest, "w1 long, w2 int, key long, key2 int, at int").repartitionByRange(*order).sortWithinPartitions(*order)


def repeated_windows(windows: DataFrame) -> DataFrame:
    """(place) of the windows that equal another, boundaries included."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, w2, key, key2, at = _whole(batches, 5)
        if not len(w1):
            return
        new = np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))
        block = np.cumsum(new) - 1
        found = np.bincount(block)[block] > 1
        edge = new & ((block == 0) | (block == block[-1]))
        use = found | edge
        yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (w1, w2.astype(np.int32), key, key2.astype(np.int32), at.astype(np.int32), found, edge)], ["w1", "w2", "key", "key2", "at", "found", "edge"])

    rows = materialize(windows.mapInArrow(compare, "w1 long, w2 int, key long, key2 int, at int, found boolean, edge boolean"), "windows")
    edges = rows.filter("edge")  # two rows a partition
    across = edges.join(edges.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter("n > 1"), ["w1", "w2"], "left_semi")
    return rows.filter("found").unionByName(across).select("key", "key2", "at", F.lit(LENGTH).alias("span")).distinct()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, key2, at, span): places that a repeated string of ``LENGTH`` bytes covers."""
    places = materialize(compared_runs(sorted_runs(docs, id_col, text_col)), "runs")
    fine = repeated_windows(open_windows(docs, places.filter("open"), id_col, text_col))
    # a partition opens a run's content once, so a place that two of them open belongs to equal rows on both sides of a boundary
    twins = places.filter("open").groupBy("key", "key2", "at", "span").agg(F.count("*").alias("n")).filter("n > 1")
    place = ("key", "key2", "at", "span")
    return places.filter("repeated").select(*place).unionByName(twins.select(*place)).unionByName(fine)


def cut(raw: bytes, at: np.ndarray, span: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """(the bytes that stay, the maximal removed runs)."""
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, at, 1)
    np.add.at(depth, at + span, -1)
    gone = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept): removed spans and the bytes that stay, one row a document."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = materialize(repeats(docs, id_col, text_col), "repeats")
    by_doc = found.groupBy("key", "key2").agg(F.collect_list(F.struct("at", "span")).alias("places"))
    hit = _filtered(docs, found, id_col, text_col).join(by_doc, ["key", "key2"], "left").select("id", "text", "places.at", "places.span")
    clean = _filtered(docs, found, id_col, text_col, others=True).select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("removed"), F.col("text").cast("binary").alias("kept"))
    clean = clean.withColumns({"n_bytes": F.coalesce("n_bytes", F.lit(0).cast("long")), "kept": F.coalesce("kept", F.lit(b""))})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i, j, data, off in slices(texts_of(batch.column(1))):
                kept, removed = [], []
                for r in range(j - i):
                    at, span = batch.column(2)[i + r], batch.column(3)[i + r]
                    raw = data[off[r] : off[r + 1]].tobytes()
                    stays, gone = cut(raw, at.values.to_numpy(), span.values.to_numpy()) if at.is_valid else (raw, [])
                    kept.append(stays)
                    removed.append([{"start": s, "end": e} for s, e in gone])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off)), pa.array(removed, spans), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    done = hit.mapInArrow(apply, f"id {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return done.unionByName(clean).withColumnRenamed("id", id_col)


def repeat_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns."""
    got = remove_repeats(docs, id_col, text_col)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.select(id_col, "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


