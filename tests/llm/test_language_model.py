from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import language_model as lm
from tests.llm.fixtures import rows, table

lm_materialize = lm.materialize


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(data):
    count = Counter(t for r in data if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    out = []
    for r in data:
        ts = tokens(r[1])
        out.append((-1 if r[0] is None else r[0], held(r[0]), len(ts), sum(count[t] > 0 for t in ts), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)))
    return sorted(out)


@pytest.mark.parametrize("head", [250_000, 20, 0])
def test_base_scores_match_brute_force(spark, monkeypatch, head):
    """With all words in the broadcast table, some, or none."""
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    monkeypatch.setattr(lm, "SAMPLE", 1)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_documents(table(spark)).collect())
    for g, w in zip(got, brute(rows()), strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and g[6] < 0


def test_filter_reads_quantised_counts(spark):
    counts = [(int(k), 1 + int(k) % 300) for k in np.random.default_rng(1).integers(-(2**62), 2**62, 4000)]
    df = spark.createDataFrame([(k, 1) for k, n in counts for _ in range(2)] + [(k, n - 2) for k, n in counts if n > 2], "key long, n long")
    f = lm.Filter(lm.build_filter(df.groupBy("key").agg(F.sum("n").alias("n")), lm.n_segments(4000, lm.MAX_BITS)))
    want = np.array([max(n, 2) for _, n in counts])
    got = f.counts(np.array([k for k, _ in counts], np.int64).view(np.uint64))
    low, high = lm.LOG_BASE ** np.floor(np.log(want) / np.log(lm.LOG_BASE) - 1e-9), want * lm.LOG_BASE
    assert (got >= low * 0.99).all() and (got <= high * 1.5).mean() > 0.97  # a false positive only raises a count
    other = np.random.default_rng(2).integers(2**62, 2**63 - 1, 4000).view(np.uint64)
    assert (f.counts(other) > 0).mean() < 0.05


def test_size_is_bounded():
    assert lm.n_segments(10**9, 1 << 21) == 2 and lm.n_segments(0, lm.MAX_BITS) == 1
    assert lm.least_level({1: 10**9, 2: 10**8, 9: 1000}, 1 << 21) == 9 and lm.least_level({1: 50, 2: 10}, 1 << 21) == 2


def test_packed_keys_come_back():
    keys = np.unique(np.random.default_rng(4).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    assert (lm.unpacked(lm.packed(keys)) == keys).all() and len(lm.unpacked(lm.packed(keys[:0]))) == 0


def test_packed_counts_come_back():
    for n in ([], [0], [0, 3, 255], [1, 70_000], [2**40, 0, 256]):
        assert lm.unpacked_counts(lm.packed_counts(np.array(n, np.int64))).tolist() == n
    assert len(lm.packed_counts(np.arange(10_000) % 2)) < 2000


def test_full_filters_hold_the_most_frequent(spark):
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 300_000)
    df = spark.range(len(keys)).select(F.xxhash64("id").alias("key"), F.when(F.col("id") < 5000, 40).otherwise(1).cast("long").alias("n"))
    f = lm.Filter(lm.build_filter(df, 1, lm.least_level({1: 295_000, 10: 5000}, 1 << 20)))
    rows_ = df.toArrow()
    got, n = f.counts(rows_["key"].to_numpy().view(np.uint64)), rows_["n"].to_numpy()
    assert (got[n == 40] >= 30).all() and (got[n == 1] > 0).mean() < 0.05


def test_head_words_are_the_most_frequent():
    words = {1: 5000, 2: 900, 3: 80, 7: 20}
    assert [lm.head_level(words, n) for n in (0, 19, 20, 100, 999, 1000, 10**6)] == [lm.MAX_LEVEL + 1] * 2 + [7, 3, 3, 2, 2]


def test_probabilities_sum_to_at_most_one():
    """Of all words behind each history, and of a word that was never seen."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(40)]
    ts = [rnd.choices(vocabulary, [1 / (1 + k) for k in range(40)])[0] for _ in range(3000)]
    uni, bi = Counter(ts), Counter(zip(ts, ts[1:]))
    level = lambda n: int(lm.levels(np.array([n]))[0]) if n else 0
    share = sum(float(lm.level_value(np.array([level(n)]))[0]) + 1 for n in uni.values()) + 1
    for h in [*vocabulary, "unseen"]:
        rows_ = [(level(uni[w]), level(uni[h]), min(level(bi[h, w]), level(uni[w]), level(uni[h]))) for w in [*vocabulary, "unseen"]]
        p = 10 ** lm.log_probabilities(*(np.array(c) for c in zip(*rows_)), share)
        assert 0.3 < p.sum() <= 1 + 1e-9


def test_bigrams_raise_the_score_of_known_text(spark):
    text = "alpha beta gamma delta epsilon"
    data = [(i, text, "en", "s", 1, 1, "x", "y") for i in range(60)]
    ids = [i for i in range(1000, 2000) if held(i)][:2]
    data += [(ids[0], text, "en", "s", 1, 1, "x", "y"), (ids[1], "epsilon delta gamma beta alpha", "en", "s", 1, 1, "x", "y")]
    got = {r.doc_id: r for r in lm.score_documents(table(spark, data)).collect()}
    assert abs(got[ids[0]].base_score - got[ids[1]].base_score) < 1e-9 and got[ids[0]].score > got[ids[1]].score


def exact_scores(data):
    """Scores by quantised counts of all words and bigrams, without a filter."""
    uni, bi = Counter(), Counter()
    for r in data:
        if not held(r[0]):
            ts = tokens(r[1])
            uni.update(ts)
            bi.update(zip([None, *ts[:-1]], ts, strict=True))
    level = lambda n: int(lm.levels(np.array([n]))[0]) if n else 0
    ends = lambda n: [float(x[0]) for x in lm.level_ends(np.array([level(n)]))]
    prior = lambda n: sum(ends(n)) / 2 + 1
    share = sum(prior(n) for n in uni.values()) + 1
    out = []
    for r in data:
        ts = tokens(r[1])
        pairs = zip([None, *ts[:-1]], ts, strict=True)
        p = [(ends(bi[h, t])[0] + lm.DIRICHLET * prior(uni[t]) / share) / (ends(uni[h])[1] + lm.DIRICHLET) for h, t in pairs]
        out.append((-1 if r[0] is None else r[0], sum(math.log10(x) for x in p)))
    return sorted(out)


@pytest.mark.parametrize("block", [4 << 20, 2000])
@pytest.mark.parametrize("load", [None, 0.002, 0.0])
def test_scores_do_not_depend_on_what_the_filter_holds(spark, monkeypatch, block, load):
    """With all repeated n-grams in the filter, the frequent ones, or none, in large and small blocks."""
    monkeypatch.setattr(lm, "HEAD_WORDS", 20)
    monkeypatch.setattr(lm, "SAMPLE", 2)
    monkeypatch.setattr(lm, "RANGE", 1000)
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    if load is not None:
        monkeypatch.setattr(lm, "LOAD", load)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.score_documents(table(spark)).collect())
    for g, w in zip(got, exact_scores(rows()), strict=True):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-6 + 0.002 * abs(w[1])  # a false positive only raises a count


def test_bigrams_of_rare_words_count(spark):
    """The words are behind more than 8,192 others by frequency."""
    common = " ".join(f"w{k} w{k}" for k in range(9000))
    ids = [i for i in range(1000, 2000) if held(i)][:2]
    train = [i for i in range(1000) if not held(i)][:2]
    data = [(train[0], common, "en", "s", 1, 1, "x", "y"), (train[1], "zeta eta theta iota", "en", "s", 1, 1, "x", "y")]
    data += [(ids[0], "zeta eta theta iota", "en", "s", 1, 1, "x", "y"), (ids[1], "iota theta eta zeta", "en", "s", 1, 1, "x", "y")]
    got = {r.doc_id: r.score for r in lm.score_documents(table(spark, data)).collect()}
    assert got[ids[0]] > got[ids[1]] + 0.5


def test_empty_tables(spark):
    assert lm.score_documents(table(spark, [])).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = lm.score_documents(table(spark, [(only_held, "a b", "en", "s", 1, 1, "x", "y")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_tables_on_disk_are_smaller_than_the_texts(spark, monkeypatch):
    """Texts lie compressed, and what goes back to blocks has no keys."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(8000)]
    data = [(i, " ".join(rnd.choices(vocabulary, k=200)), "en", "s", 1, 1, "x", "y") for i in range(1000)]
    written = []
    monkeypatch.setattr(lm, "materialize", lambda df, label, **how: written.append((label, lm_materialize(df, label, **how))) or written[-1][1])
    assert lm.score_documents(table(spark, data)).count() == 1000
    size = {label: sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles()) for label, df in written}
    text = sum(len(r[1]) for r in data)
    assert size["pieces"] < 0.7 * text and size["counts"] < 0.6 * text


def test_blocks_read_in_parts_are_scored_whole(spark, monkeypatch):
    """A file of pieces may be split among tasks, so a block's n-grams come in several runs."""
    monkeypatch.setattr(lm, "PACK_BYTES", 500)
    want = sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, r.base_score, r.score) for r in lm.score_documents(table(spark)).collect())
    monkeypatch.setattr(lm, "materialize", lambda df, label, **how: lm_materialize(df, label, **how).repartition(7))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_known, r.base_score, r.score) for r in lm.score_documents(table(spark)).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_shuffle_files_go_with_the_table_they_made(spark):
    """A query that goes on must not find the disk full of them."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {f for f in (str(b) for b in local.getAllBlocks().mkString(",").split(",")) if f.startswith("shuffle")}
    before = left()
    df = lm_materialize(spark.range(10_000).repartition(5, "id"), "shuffled", once=True)
    assert left() <= before and df.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
