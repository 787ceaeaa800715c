from __future__ import annotations

import random
import re

import pytest

from jobloom.llm import _shared, neardup
from jobloom.llm import components as components_of
from jobloom.llm.components import components
from tests.llm.fixtures import rows, table


def shingles(text: str | None, width: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(data: list[tuple], width: int) -> list[tuple]:
    sets = [shingles(r[1], width) for r in data]
    group = list(range(len(data)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and 100 * n >= 80 * (len(a) + len(b) - n):
                group[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(data):
        if r[0] is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((-1 if r[0] is None else r[0], len(sets[i]), (-1 if (c := least.get(find(i)) if sets[i] else r[0]) is None else c)) for i, r in enumerate(data))


def run(spark, data, width):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in neardup.near_duplicates(table(spark, data), width=width).collect())


def test_matches_brute_force(spark):
    assert run(spark, rows(), 4) == brute(rows(), 4)


def test_chains_and_groups(spark):
    """Chains of edits, whose ends are not linked themselves, and a large group around one text."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    data, i = [], 0
    base = [word() for _ in range(150)]
    for _ in range(14):
        data.append((i, " ".join(base), "en", "s", 1, 1, "x", "y"))
        base = [*base]
        for _ in range(rnd.randint(1, 4)):
            base[rnd.randrange(len(base))] = word()
        i += 1
    hub = [word() for _ in range(200)]
    for _ in range(60):
        t = [*hub]
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = word()
        data.append((i, " ".join(t), "en", "s", 1, 1, "x", "y"))
        i += 1
    assert run(spark, data, 5) == brute(data, 5)


def test_versions_of_one_text(spark, monkeypatch):
    """Members of long lists are listed again by their full sets: most versions differ too much from each other, some do not."""
    monkeypatch.setattr(neardup, "SHORT", 3)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    data = []
    for size in (90, 300):
        base = [word() for _ in range(size)]
        for i in range(50):
            t = [*base]
            for _ in range(rnd.choice([size // 60, size // 25, size // 15])):
                t[rnd.randrange(size)] = word()
            data.append((size * 100 + i, " ".join(t), "en", "s", 1, 1, "x", "y"))
    want = brute(data, 4)
    assert 10 < len({c for _, _, c in want}) < 100 and run(spark, data, 4) == want
    monkeypatch.setattr(neardup, "LIST_PART", 5)
    assert run(spark, data, 4) == want


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LIST_PART", 5)
    assert run(spark, rows(), 4) == brute(rows(), 4)


def test_no_documents(spark):
    assert run(spark, [], 4) == []


def test_one_row_of_each_component_stays(spark):
    data = rows()
    docs = table(spark, data)
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    bare = [r for r in data if not shingles(r[1], 5)]
    assert sum(not shingles(r.text, 5) for r in got) == len(bare)
    groups = {g for i, _, g in brute(data, 5) if data and i not in {b[0] for b in bare}}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got if shingles(r.text, 5)) == sorted(groups)


def test_rows_of_one_id_are_told_apart_by_text(spark):
    a, b = "one two three four five six seven", "completely other words stand in this text"
    data = [(1, t, "en", "s", 1, 1, "x", "y") for t in (a, a, b, a + " ")] + [(2, b, "en", "s", 1, 1, "x", "y"), (3, None, "en", "s", 1, 1, "x", "y"), (3, None, "en", "s", 1, 1, "x", "y")]
    got = neardup.without_near_duplicates(table(spark, data)).collect()
    assert sorted((r.doc_id, (r.text or "").strip()) for r in got) == [(1, b), (1, a), (3, ""), (3, "")]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 10), (10, 9), (5, 5), (None, 4), (3, 1)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8} | {100 + k: 100 for k in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_are_not_stable_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not stable after 1 rounds"):
        components(chain, most_rounds=1)
    assert {r.component for r in components(chain).collect()} == {0}


def test_small_tables_have_a_file_a_core_not_one_a_shuffle_partition(spark, monkeypatch):
    """Local file systems start two processes a file, each as large as the executor for a moment."""
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, files = {k: spark.conf.get(k) for k in settings}, {}
    keep = neardup.materialize

    def noted(df, label, *args, **sized):
        out = keep(df, label, *args, **sized)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    for module in (neardup, components_of):
        monkeypatch.setattr(module, "materialize", noted)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert run(spark, rows(n=120), 4) == brute(rows(n=120), 4)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cores = max(2, spark.sparkContext.defaultParallelism)
    assert {"classes", "stars", "links", "met", "components", "lists", "groups"} <= set(files)
    assert all(n <= cores for label in files.keys() - {"signed", "likely"} for n in files[label])


def test_workers_give_memory_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(_shared, "give_back", lambda: calls.append(1))
    assert list(_shared.released(lambda batches: (2 * b for b in batches))(iter([1, 2]))) == [2, 4] and calls == [1]
