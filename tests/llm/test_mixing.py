from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction

from jobloom.llm import mixing
from tests.llm.fixtures import rows, table


def sizes(data):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]


def level(size: dict) -> dict:
    """Targets by resharing the excess until none is above its cap."""
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        rest = total - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        share = {s: Fraction(rest * w[s], sum(w[x] for x in open_)) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return {**{s: float(x) for s, x in fixed.items()}, **{s: float(x) for s, x in share.items()}}
        fixed |= {s: 3 * size[s] for s in over}


def test_targets_and_taken(spark):
    data = rows()
    got = mixing.mix(table(spark)).collect()
    n = sizes(data)
    assert Counter(r.size for r in got) == Counter(n)
    source = defaultdict(int)
    for r, k in zip(data, n, strict=True):
        source[r[3]] += k
    want = level(source)
    by = {r[0]: r[3] for r in data}
    for r in got:
        assert r.source_size == source[by[r.doc_id]] and abs(r.target - want[by[r.doc_id]]) < 1e-6
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    taken, largest = Counter(), Counter()
    for r in got:
        taken[by[r.doc_id]] += r.taken
        largest[by[r.doc_id]] = max(largest[by[r.doc_id]], r.size)
    assert sum(taken.values()) <= sum(n)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * max(largest.values()), (s, taken[s], t)


def test_reruns_agree(spark):
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    unique = [r for i, r in enumerate(rows()) if r[0] is not None and i < 80]
    a, b = (sorted(map(key, mixing.mix(table(spark, x)).collect())) for x in (unique, unique[::-1]))
    assert a == b


def test_empty_and_wordless(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    blank = [(1, None, None, None, None, None, None, None), (2, " ", None, "a", None, None, None, None)]
    assert [(r.size, r.taken, r.target) for r in mixing.mix(table(spark, blank)).collect()] == [(0, 0, 0.0)] * 2


def test_documents_are_repeated(spark):
    got = Counter((r.doc_id, r.text) for r in mixing.mixed_documents(table(spark)).collect())
    want = Counter()
    for r in mixing.mix(table(spark)).collect():
        want[r.doc_id] += r.copies
    assert Counter({k: v for k, v in want.items() if v}).total() == got.total()
    assert mixing.mixed_documents(table(spark)).columns == table(spark).columns


def test_columns_with_clashing_names_come_back(spark):
    df = spark.createDataFrame([(i, "one two three", "a", 7, 8, 9, 10, 11) for i in range(20)], "doc_id long, text string, source string, row long, _row long, copies int, doc int, size long")
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns and {tuple(r)[1:] for r in got.collect()} == {("one two three", "a", 7, 8, 9, 10, 11)}
