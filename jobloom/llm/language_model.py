"""Language-model scores from a log-frequency Bloom filter.

Counts of all words and all bigrams of the training documents are summed over
the cluster, quantised to ``1 + floor(log_b count)`` levels and stored, level by
level, in a Bloom filter (Talbot and Osborne, "Smoothed Bloom Filter Language
Models", 2007).  The broadcast filter has a bounded size and holds the n-grams
from a least level on, at least level 2; a probe that ends below that level
decides nothing.  What it does not hold is exchanged exactly, so none is left
out at any size:

1. Texts are dealt into blocks of about ``BLOCK_BYTES`` and written compressed,
   some ``PACK_BYTES`` a row.  The n-grams of a share of the key space are
   counted first; they tell, to within a little, how many n-grams have each
   level, and so what the filter can hold.
2. Each block sends its distinct n-grams with their counts in it, so an entry
   stands for all places of an n-gram in a block, and a hot n-gram has one
   entry a block at most.  Entries travel as packed runs of ascending keys.
3. The entries of one range of keys are summed.  N-grams from the least level
   on go to the filter, frequent words to a table; the count of any other goes
   back to each block whose own count does not tell the whole one.  Counts go
   without keys, as a block finds its ascending keys again.
4. Each block meets its counts and is scored.

The filter is blocked: all probes of one n-gram lie in one segment, so each task
builds whole segments from the n-grams dealt to it, and only the finished bits
travel to the driver and on to the workers.

A word's probability is its bigram count, read by repeated membership probes,
smoothed with a Dirichlet prior of unigram probabilities read the same way:
``(low(pair) + D * p(word)) / (high(history) + D)``, where ``low`` and ``high``
are the ends of a level, and ``p(word)`` is normalised over the levels of all
words.  So the probabilities of all words behind a history sum to at most 1, up
to the filter's false positives.  The base score is the exact add-one unigram
score, from exact counts.

Defined results: a null or empty text is one end token; with no training
documents all counts, N and V are 0, every probability is 1 and scores are 0;
very long texts are scored whole, each in a block of its own if need be; ties
have no effect, as nothing is ranked; repeated rows are scored each; a null id
counts as '' for the split; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import byte_view, combine, crc_mod, freed, give_back, hash_words, in_small_batches, mix64, slices, texts_of
from jobloom.storage import discard, materialize, release

#: Stands for the end of a text, and for the start as a history.
END = np.uint64(0x656E642D6F662D74)
#: Separates unigram keys from bigram keys.
UNIGRAM = np.uint64(0x756E6967)
LOG_BASE = 1.5
MAX_LEVEL = 64
PROBES = 3
SEGMENT_BITS = 1 << 20
#: The broadcast filter never exceeds so many bits (32 MB), whatever the corpus.
MAX_BITS = 1 << 28
BITS_PER_KEY = 16
#: Stored (n-gram, level, probe) triples a bit at most: a probe of an empty place hits with a chance of 0.3.
LOAD = 0.35
#: At most so many of the most frequent words are broadcast for the exact counts.
HEAD_WORDS = 250_000
#: Bytes of text in a block, or one longer text.
BLOCK_BYTES = 8 << 20
#: Bytes of text that a row has, compressed, or one longer text.
PACK_BYTES = 1 << 16
#: Rows of packed texts that are counted at once, and keys that are probed at once.
COUNTED, PROBED = 32, 1 << 17
#: Block numbers of rows that go to no block: an n-gram's count, how many n-grams have a level, the sum of word counts.
WHOLE, LEVEL, TOKENS = -1, -2, -3
#: The share of the key space that is counted to choose levels, and entries that one range of keys has, about.
SAMPLE, RANGE = 64, 1 << 20
DIRICHLET = 2000.0


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with the end behind each text, their text, offsets by text)."""
    words, doc = hash_words(data, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(bounds[-1], END, np.uint64)
    own = np.ones(len(out), bool)
    own[bounds[1:] - 1] = False
    out[own] = words
    return out, np.repeat(np.arange(len(n)), n + 1), bounds


def histories(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each, the end standing before the first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[bounds[:-1]] = END
    return before


def keys_of(tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unigram keys, bigram keys); the last bit tells which."""
    one = np.uint64(1)
    return mix64(tokens ^ UNIGRAM) & ~one, combine([before, tokens]) | one


def positions(keys: np.ndarray, level: np.ndarray, segments: int) -> np.ndarray:
    """``PROBES`` bit positions of each (key, level), all in the key's segment; shape (PROBES, n)."""
    seg = (keys >> np.uint64(40)) % np.uint64(segments)
    x = mix64(keys + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    inside = [(x >> np.uint64(20 * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(PROBES)]
    return np.stack([(seg * np.uint64(SEGMENT_BITS) + p).astype(np.int64) for p in inside])


def levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(LOG_BASE) + 1e-9), MAX_LEVEL).astype(np.int64)


def level_ends(level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) whole count of each level, 0 for level 0."""
    first = np.ceil(LOG_BASE ** (np.maximum(level, 1) - 1.0) - 1e-6)
    last = np.maximum(first, np.ceil(LOG_BASE ** np.maximum(level, 1.0) - 1e-6) - 1)
    return np.where(level > 0, first, 0.0), np.where(level > 0, last, 0.0)


def level_value(level: np.ndarray) -> np.ndarray:
    """The middle of a level's whole counts, 0 for level 0."""
    first, last = level_ends(level)
    return (first + last) / 2


class Filter:
    """Counts read from the bits by repeated membership probes."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.segments = bits, len(bits) * 8 // SEGMENT_BITS

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(self._levels(keys[i : i + PROBED]) for i in range(0, len(keys), PROBED))])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        level, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        while len(open_) and level[open_[0]] < MAX_LEVEL:
            p = positions(keys[open_], level[open_] + 1, self.segments)
            hit = np.ones(len(open_), bool)
            for row in p:
                hit &= (self.bits[row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1
            open_ = open_[hit]
            level[open_] += 1
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return level_value(self.levels(keys))


def pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, held, lengths, texts): the documents, as a written table, dealt into blocks in the order they are read; some texts a row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size, packer = TaskContext.get().partitionId() << 24, 0, pa.Codec("zstd", compression_level=5)
        for batch in freed(batches):
            texts = texts_of(batch.column(2))
            off = byte_view(texts)[1]
            # a text belongs to the block that its last byte falls in
            block = first + np.maximum(size + off[1:] - 1, 0) // BLOCK_BYTES
            size += int(off[-1])
            cuts, lengths, packs = [0], [], []
            for a, z in stretches(block):
                for _, j, data, own in slices(texts.slice(a, z - a), PACK_BYTES):
                    cuts.append(a + j)
                    lengths.append(np.diff(own).astype("<i4").tobytes())
                    packs.append(packer.compress(data.tobytes(), asbytes=True))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(k)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *lists, pa.array(lengths, pa.binary()), pa.array(packs, pa.binary())], ["block", "ids", "held", "lengths", "texts"])

    held = crc_mod(F.col(id_col), 7) == 2
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    return materialize(in_small_batches(rows).mapInArrow(deal, f"block long, ids array<{kind}>, held array<boolean>, lengths binary, texts binary"), "pieces")


def stretches(block: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of equal numbers."""
    edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
    return ((i, j) for i, j in zip(edges, edges[1:], strict=False) if i < j)


def unpacked_texts(lengths: bytes, texts: bytes) -> pa.Array:
    """The texts of a row of ``pieces``."""
    off = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, "<i4")))).astype(np.int32)
    data = pa.decompress(texts, int(off[-1]), "zstd") if off[-1] else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off), data])


def tally(texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """(distinct keys, their counts in texts that are not held out, each slice's places and keys)."""
    parts, seen = [], []
    for i, j, data, off in slices(texts):
        tokens, doc, bounds = tokens_of(data, off)
        uni, bi = keys_of(tokens, histories(tokens, bounds))
        keys, which = np.unique(np.concatenate((uni, bi)), return_inverse=True)
        weight = np.tile(~held[i:j][doc], 2)
        parts.append((keys, np.bincount(which, weight, len(keys)).astype(np.int64)))
        seen.append((i, j, bounds, keys, which))
    return *_summed(parts), seen


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)


def by_block(batches: Iterator[pa.RecordBatch], counted: Callable[[pa.Array, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, distinct keys, counts) of runs of rows (block, held, lengths, texts) of one block."""
    have, parts = None, []
    for batch in freed(batches):
        block = batch.column(0).to_numpy()
        for i, j in stretches(block):
            if parts and block[i] != have:
                yield have, *_summed(parts)
                parts = []
            have = int(block[i])
            for k in range(i, j, COUNTED):
                some = batch.slice(k, min(COUNTED, j - k))
                parts.append(counted(*rows_of(some.column(1), some.column(2), some.column(3))))
                give_back()
    if parts:
        yield have, *_summed(parts)


def rows_of(held: pa.Array, lengths: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts, whether each is held out) of rows of ``pieces``."""
    parts = [unpacked_texts(n, x) for n, x in zip(lengths.to_pylist(), texts.to_pylist(), strict=True)]
    return pa.concat_arrays(parts), held.flatten().to_numpy(zero_copy_only=False)


def sampled_counts(rows: DataFrame) -> tuple[dict[int, int], dict[int, int], int]:
    """(words by level, pairs by level, entries of all blocks), estimated from one of ``SAMPLE`` parts of the key space."""

    def some(texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i, j, data, off in slices(texts):
            tokens, doc, bounds = tokens_of(data, off)
            keys, weight = np.concatenate(keys_of(tokens, histories(tokens, bounds))), np.tile(~held[i:j][doc], 2)
            use = (keys >> np.uint64(1)) % np.uint64(SAMPLE) == 0
            k, which = np.unique(keys[use], return_inverse=True)
            parts.append((k, np.bincount(which, weight[use], len(k)).astype(np.int64)))
        return _summed(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, n in by_block(batches, some):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    counts = in_small_batches(rows.select("block", "held", "lengths", "texts")).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("entries"))
    level = F.when(F.col("n") > 0, level_column(F.col("n"))).otherwise(0)
    words, pairs, entries = {}, {}, 0
    for r in counts.groupBy(level.alias("level"), F.pmod("key", F.lit(2)).alias("kind")).agg(F.count("*").alias("keys"), F.sum("entries").alias("entries")).collect():  # two rows a level
        entries += r.entries * SAMPLE
        if r.level:
            (pairs if r.kind else words)[r.level] = r["keys"] * SAMPLE
    return words, pairs, entries


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as the byte planes of their differences; the upper ones are zeros."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def packed_counts(n: np.ndarray) -> bytes:
    """Counts, most of them small: how many, the bytes of each, and their compressed byte planes."""
    kind = np.min_scalar_type(int(n.max(initial=0)))
    planes = np.ascontiguousarray(n.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)
    return np.array([len(n), kind.itemsize], "<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked_counts(raw: bytes) -> np.ndarray:
    size, width = np.frombuffer(raw, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(raw[16:], size * width, "zstd"), np.uint8) if size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"u{width}").ravel().astype(np.int64)


ENTRIES = "part int, block long, keys binary, n binary"


def block_counts(rows: DataFrame, parts: int) -> DataFrame:
    """(part, block, keys, n): the n-grams of each block by range of keys, and their training counts there; they may be 0."""
    width = np.uint64((1 << 64) // parts + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, n in by_block(batches, lambda texts, held: tally(texts, held)[:2]):
            part, first = np.unique(keys // width, return_index=True)
            ends = [*first[1:].tolist(), len(keys)]
            runs = [(packed(keys[i:j]), packed_counts(n[i:j])) for i, j in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), block, np.int64)), pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.binary())], ["part", "block", "keys", "n"])

    return in_small_batches(rows.select("block", "held", "lengths", "texts")).mapInArrow(count, ENTRIES)


def whole_counts(counts: DataFrame, parts: int, least: int, frequent: int) -> DataFrame:
    """(block, key, n, sums): whole counts of n-grams from their levels on, statistics, and the answers to blocks.

    An answer has its range of keys as ``key``, and for each of the block's
    ascending keys in it the whole count, or 0 where the block needs none.
    """
    names = ["block", "key", "n", "sums"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, tokens = np.zeros(2 * (MAX_LEVEL + 1), np.int64), 0

        def plain(block: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block, np.int64)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.binary())], names)

        def made(part: int, held: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal tokens
            blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for block, run, own in held:
                blocks.setdefault(block, []).append((unpacked(run), unpacked_counts(own)))
            # a block that was read in parts has more runs than one
            runs, own = zip(*(x[0] if len(x) == 1 else _summed(x) for x in blocks.values()), strict=True)
            n = np.concatenate(own)
            keys, of = np.unique(np.concatenate(runs), return_inverse=True)
            total = np.bincount(of, n, len(keys)).astype(np.int64)
            level, word = np.where(total > 0, levels(total), 0), keys & np.uint64(1) == 0
            stats[:] += np.bincount(2 * level + word, minlength=len(stats))
            tokens += int(total[word].sum())
            some = (level >= least) | word & (level >= frequent)
            yield plain(WHOLE, keys[some].view(np.int64), total[some])
            # a word that is frequent is read from the table, and an n-gram from the least level on from the filter
            asked = np.where(word, level < max(least, frequent), level < least)
            differs = (level[of] != np.where(n > 0, levels(n), 0)) | word[of] & (total[of] != n)
            answer = np.where(asked[of] & differs, total[of], 0)
            edges = np.cumsum([len(r) for r in runs])[:-1]
            sums = [packed_counts(x) for x in np.split(answer, edges)]
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(np.full(len(blocks), part, np.int64)), pa.nulls(len(blocks), pa.int64()), pa.array(sums, pa.binary())], names)

        last, held = None, []
        for batch in batches:
            for part, block, keys, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if part != last and held:
                    yield from made(last, held)
                    held = []
                last = part
                held.append((block, keys, n))
        if held:
            yield from made(last, held)
        at = np.flatnonzero(stats)
        yield plain(LEVEL, at, stats[at])
        yield plain(TOKENS, np.zeros(1, np.int64), np.array([tokens]))

    ordered = counts.repartition(parts, "part").sortWithinPartitions("part")
    return ordered.mapInArrow(walk, "block long, key long, n long, sums binary")


def is_in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each key is in the sorted ones, where)."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def head_level(words: dict[int, int], limit: int) -> int:
    """The least level from which on words are broadcast: at most ``limit`` words."""
    upto, least = 0, MAX_LEVEL + 1
    for at in sorted(words, reverse=True):
        upto += words[at]
        if upto > limit or at < 2:
            break
        least = at
    return least


def level_column(n: Column) -> Column:
    return F.least(1 + F.floor(F.log(n) / F.log(F.lit(LOG_BASE)) + 1e-9), F.lit(MAX_LEVEL)).cast("int")


def n_segments(n_keys: int, max_bits: int) -> int:
    return min(1 << max(0, (n_keys * BITS_PER_KEY // SEGMENT_BITS).bit_length()), max_bits // SEGMENT_BITS)


def least_level(keys: dict[int, int], n_bits: int) -> int:
    """The least level of an n-gram that a filter of ``n_bits`` stores, by the load that results from the numbers of n-grams by level; 2 at least."""
    load, least = 0.0, max(keys, default=1) + 1
    for at in sorted(keys, reverse=True):
        load += keys[at] * at * PROBES
        if load > LOAD * n_bits or at < 2:
            break
        least = at
    return least


def build_filter(counts: DataFrame, segments: int, least: int = 1) -> np.ndarray:
    """The filter's bits from rows (key, n), keys distinct; one shuffle by the segment of a key.

    It has ``segments`` segments and holds the keys from level ``least`` on.
    """
    spark = counts.sparkSession
    seg = F.pmod(F.shiftrightunsigned("key", 40), F.lit(segments))
    n_parts = max(1, min(segments, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, level = batch.column(0).to_numpy().view(np.uint64), levels(batch.column(1).to_numpy())
            for j in range(1, int(level.max(initial=0)) + 1):
                k = keys[level >= j]
                p = positions(k, np.full(len(k), j), segments).ravel()
                p = p[np.argsort(p // SEGMENT_BITS, kind="stable")]
                s, first = np.unique(p // SEGMENT_BITS, return_index=True)
                for one, at in zip(s.tolist(), np.split(p % SEGMENT_BITS, first[1:]), strict=True):
                    have.setdefault(one, np.zeros(SEGMENT_BITS, bool))[at] = True
        for s, own in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    stored = counts.filter(level_column(F.col("n")) >= least).select("key", "n")
    made = stored.repartition(n_parts, seg).mapInArrow(fill, "segment long, bits binary")
    bits = np.zeros(segments * SEGMENT_BITS // 8, np.uint8)
    for r in made.collect():  # one row a segment
        at = r.segment * SEGMENT_BITS // 8
        bits[at : at + SEGMENT_BITS // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def log_probabilities(word: np.ndarray, history: np.ndarray, pair: np.ndarray, share: float) -> np.ndarray:
    """log10 of the smoothed probability of words by the levels of their counts."""
    first, last = (x.astype(float) for x in level_ends(np.arange(MAX_LEVEL + 1)))
    prior = ((first + last) / 2 + 1) / share
    return np.log10((first[pair] + DIRICHLET * prior[word]) / (last[history] + DIRICHLET))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row a document."""
    spark = docs.sparkSession
    rows = pieces(docs, id_col, text_col)
    words, pairs, entries = sampled_counts(rows)
    by_level = {k: words.get(k, 0) + pairs.get(k, 0) for k in words | pairs}
    segments = n_segments(sum(by_level.values()), max_bits)
    least, frequent = least_level(by_level, segments * SEGMENT_BITS), head_level(words, HEAD_WORDS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // RANGE))
    whole = materialize(whole_counts(block_counts(rows, parts), parts, least, frequent), "counts", once=True)
    release(spark)
    words, n_train = {}, 0
    for r in whole.filter(F.col("block").isin(LEVEL, TOKENS)).groupBy("block", "key").agg(F.sum("n").alias("n")).collect():  # two rows a level
        if r.block == TOKENS:
            n_train = int(r.n)
        elif r.key % 2 and r.key > 1:
            words[r.key // 2] = int(r.n)
    vocabulary, level, is_word = sum(words.values()), level_column(F.col("n")), F.pmod("key", F.lit(2)) == 0
    if sum(n for k, n in words.items() if k >= frequent) > 2 * HEAD_WORDS:
        raise RuntimeError("the sampled levels of words are far from the counted ones")
    sums = whole.filter(F.col("block") == WHOLE).select("key", "n")
    bits = build_filter(sums, segments, least)
    head = sums.filter(is_word & (level >= frequent)).toArrow()  # at most twice HEAD_WORDS rows
    order = np.argsort(head["key"].to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast((bits, head["key"].to_numpy().view(np.uint64)[order], head["n"].to_numpy()[order]))
    share = float(n_train + vocabulary + 1)
    prior_share = sum(n * (float(level_value(np.array([k]))[0]) + 1) for k, n in words.items()) + 1

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        bits_, head_keys, head_counts = shared.value
        model = Filter(bits_)
        texts = texts.combine_chunks()
        whole_texts, held = rows_of(*(texts[c].combine_chunks() for c in ("held", "lengths", "texts")))
        keys, own, seen = tally(whole_texts, held)
        told = [unpacked_counts(x) for x in answers.sort_by("key")["sums"].to_pylist()]
        told = np.concatenate(told) if told else np.zeros(0, np.int64)
        if len(told) != len(keys):
            raise RuntimeError("a block's answers do not fit its n-grams")
        exact = np.where(told > 0, told, own)
        del told, own
        known, at = is_in(head_keys, keys)
        exact = np.where(known, head_counts[at], exact) if len(head_keys) else exact
        level = model.levels(keys)
        level = np.where(level >= least, level, np.where(exact > 0, levels(exact), 0))
        base_log = np.log10((exact + 1.0) / share)
        out = [[], [], [], []]
        for i, j, bounds, some, which in seen:
            at = np.searchsorted(keys, some)[which]
            uni, bi = at[: bounds[-1]], at[bounds[-1] :]
            word = level[uni]
            history = np.empty_like(word)
            history[1:] = word[:-1]
            history[bounds[:-1]] = word[bounds[1:] - 1]
            # no pair is more frequent than its words
            pair = np.minimum(level[bi], np.minimum(word, history))
            terms = log_probabilities(word, history, pair, prior_share)
            for x, values in zip(out, (np.diff(bounds), np.add.reduceat((exact[uni] > 0).astype(np.int64), bounds[:-1]), np.add.reduceat(base_log[uni], bounds[:-1]), np.add.reduceat(terms, bounds[:-1])), strict=True):
                x.append(values)
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        del seen, keys, exact, level, base_log, whole_texts
        give_back()
        return pa.table([texts["ids"].combine_chunks().flatten(), pa.array(held), *(pa.array(c) for c in columns)], ["id", "held", "n_tokens", "n_known", "base", "score"])

    answers = whole.filter(F.col("block") >= 0).select("block", "key", "sums")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"id {kind}, held boolean, n_tokens long, n_known long, base double, score double")
    return scored.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
