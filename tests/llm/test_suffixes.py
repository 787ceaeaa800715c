from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from jobloom.llm import suffixes
from tests.llm.fixtures import rows, table


def brute(texts: list[bytes]) -> list[np.ndarray]:
    n = suffixes.LENGTH
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append(gone)
    return out


def expected(data: list[tuple]) -> list[tuple]:
    texts = [(r[1] or "").encode() for r in data]
    out = []
    for r, t, gone in zip(data, texts, brute(texts), strict=True):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((-1 if r[0] is None else r[0], len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, data):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeat_digest(table(spark, data)).collect())


def test_edge_cases_match_brute_force(spark):
    assert run(spark, rows()) == expected(rows())


def test_shared_passages_in_many_contexts(spark):
    """One passage in most rows, at all offsets, so its runs are in many different contexts."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    passage = " ".join(word() for _ in range(70))
    data = []
    for i in range(90):
        own = " ".join(word() for _ in range(rnd.randint(0, 60)))
        cut = rnd.randrange(len(passage)) if i % 4 == 0 else 0
        data.append((i, own + " " + passage[cut:] + " " + own[::-1], "en", "s", 1, 1, "x", "y"))
    assert run(spark, data) == expected(data)


def test_windows_lie_in_exactly_one_run():
    rnd = random.Random(1)
    texts = [bytes(rnd.choice(b"abc ") for _ in range(rnd.randint(0, 900))) for _ in range(20)] + [b"a" * 500, b""]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    _, _, text, at, span = suffixes.runs_of(np.frombuffer(b"".join(texts), np.uint8), off)
    seen = Counter((int(t), p) for t, a, s in zip(text, at, span, strict=True) for p in range(a, a + s - suffixes.LENGTH + 1))
    assert set(seen) == {(r, p) for r, t in enumerate(texts) for p in range(len(t) - suffixes.LENGTH + 1)} and set(seen.values()) == {1}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_equal_rows_on_both_sides_of_a_boundary(spark):
    """Each run in a partition of its own, or nearly: copies are compared across boundaries."""
    rnd = random.Random(5)
    text = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n)).decode()
    t = text(3000)
    data = [(1, t), (1, t), (2, text(2500)), (3, t[500:1200] + text(100)), (4, text(900)), (4, None), (5, None), (5, None)]
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    try:
        for parts in ("4", "64"):
            for n, v in zip(names, ("false", parts), strict=True):
                spark.conf.set(n, v)
            for rows_ in (data, [*data, (1, t)], [(i, t) for i in (1, 1, 2, 2)]):
                full = [(*r, None, None, None, None, None, None) for r in rows_]
                assert run(spark, full) == expected(full)
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)


def test_text_ids_and_nulls_are_told_apart(spark):
    t = "".join(random.Random(6).choice("abcdefgh") for _ in range(700))
    docs = spark.createDataFrame([(t, None), (None, t), ("z", t)], "doc_id string, text string")
    got = sorted((r.doc_id or "", r.n_bytes, r.n_removed) for r in suffixes.repeat_digest(docs).collect())
    assert got == [("", 700, 700), (t, 0, 0), ("z", 700, 700)]
