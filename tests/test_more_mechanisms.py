"""Seeded documents, verified fast paths, exact plans as rounds."""

from __future__ import annotations

import itertools
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobloom.operators import relational
from jobloom.operators.verify import verified
from jobloom.plans import multi
from jobloom.sources import documents, synthetic

# ---------------------------------------------------------------- seeded documents


def test_seeded_documents_do_not_depend_on_partitions(spark, tmp_path):
    rows = spark.range(300).withColumnRenamed("id", "row")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(30,0)"))).first()
    one = synthetic.seeded_documents(rows.repartition(1), 5)
    assert digest(one) == digest(synthetic.seeded_documents(rows.repartition(64), 5)) != digest(synthetic.seeded_documents(rows, 6))
    part = synthetic.seeded_documents(rows.filter("row % 7 = 3").repartition(5), 5)
    assert part.exceptAll(one).isEmpty() and part.count() == 43
    for r in one.limit(50).collect():
        doc = json.loads(r.document)
        assert doc["name"] == r.name and doc["modelSeeds"] == list(range(1, r.n_seeds + 1)) and doc["sequences"][0][r.kind]["sequence"] == r.sequence
        assert 1 <= len(r.sequence) <= synthetic.MOST and set(r.sequence) <= set(synthetic.LETTERS)
    assert len({r.sequence for r in one.collect()}) > 290
    odd = spark.createDataFrame([(1,), (1,), (None,)], "row long")
    assert [r.row for r in synthetic.seeded_documents(odd, 5).collect()] == [1, 1]
    one.limit(20).select("document").coalesce(2).write.option("lineSep", "\0").text(str(tmp_path / "d"))
    for k, r in enumerate(one.limit(20).collect()):
        (tmp_path / f"{k}.json").write_text(r.document)
    jobs, rejects = documents.scan(spark, str(tmp_path), [512])
    assert jobs.count() == 20 and rejects.count() == 0


# ---------------------------------------------------------------- verified fast paths


def one_pass(rows, fast, plain, first):
    """(slot, at) to (result, path, checked), row by row."""
    out, state = {}, {}
    for slot, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        seen, ok = state.get(slot, (0, True))
        checking = ok and seen < first
        got = fast(at) if ok else None
        if checking and got != plain(at):
            ok = False
        state[slot] = (seen + checking, ok)
        out[slot, at] = (got if ok else plain(at), "fast" if ok else "plain", checking)
    return out


@pytest.mark.parametrize(("wrong", "first"), [((), 3), ((1,), 3), ((5,), 3), ((0,), 1), ((2,), 3), ((0, 1), 0), ((2, 4), 50)])
@pytest.mark.parametrize("batch", ["10000", "2"])
def test_the_fast_path_is_given_up_at_the_first_difference(spark, wrong, first, batch):
    rows = [(s, k) for s in ("a", "b", None) for k in range(8)]
    off = lambda at, slot=None: at in wrong
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = verified(spark.createDataFrame(rows, "slot string, at long").repartition(3), "slot", ["at"], lambda p: p["at"] * 10 + p["at"].isin(wrong), lambda p: p["at"] * 10, "bigint", first).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = one_pass(rows, lambda at: at * 10 + off(at), lambda at: at * 10, first)
    assert {(r.slot, r.at): (r.result, r.path, r.checked) for r in got} == want


def test_a_fast_path_that_fails_is_given_up(spark):
    def fast(p: pd.DataFrame) -> pd.Series:
        raise RuntimeError("off")

    got = verified(spark.createDataFrame([("a", k) for k in range(5)], "slot string, at long"), "slot", ["at"], fast, lambda p: p["at"] + 1, "bigint").collect()
    assert [(r.result, r.path) for r in sorted(got, key=lambda r: r.at)] == [(k + 1, "plain") for k in range(5)]


# ---------------------------------------------------------------- exact plans as rounds


@pytest.mark.parametrize("executors", [1, 2, 3, 5])
def test_rounds_of_joins_equal_enumeration(spark, executors):
    rnd = random.Random(executors)
    costs, want = [[] for _ in range(executors)], {}
    for key in range(6):
        n = rnd.randint(1, 5)
        table = [[0] + [rnd.randint(1, 90) for _ in range((1 << n) - 1)] for _ in range(executors)]
        for g in range(executors):
            costs[g] += [(key, n, m, c) for m, c in enumerate(table[g])]
        deals = itertools.product(range(executors), repeat=n)
        want[key] = min(max(table[g][sum(1 << j for j, x in enumerate(d) if x == g)] for g in range(executors)) for d in deals)
    frames = [spark.createDataFrame(c, "key long, n int, mask int, cost long") for c in costs]
    assert {r.key: r.makespan for r in multi.exact_rounds(frames, "key").collect()} == want


def test_many_jobs_of_a_key_are_planned_exactly(spark):
    """Keys of up to 14 jobs, by deals, by loads and by rounds: joining all sets looked at 4 ** 14 pairs of one key."""
    rnd = random.Random(3)
    jobs = {key: [rnd.choice((1, 50, 10**6)) if key % 2 else rnd.randint(0 if key == 4 else 1, 50) for _ in range(n)] for key, n in enumerate((1, 2, 5, 7, 9, 9, 11, 14))}
    prices = [(7, 2), (14, 3), (21, 5)]

    def best(sizes: list[int]) -> int:
        loads = {((0, False),) * 3}
        for x in sizes:
            loads = {(*s[:g], (s[g][0] + x, True), *s[g + 1 :]) for s in loads for g in range(3)}
        return min(max(start + speed * units if used else 0 for (units, used), (start, speed) in zip(s, prices, strict=True)) for s in loads)

    want = {key: best(sizes) for key, sizes in jobs.items()} | {8: None, 9: best([5])}
    rows = [*jobs.items(), (8, [None]), (9, [None, 5, None])]
    frame = spark.createDataFrame(rows, "key long, q array<long>")
    assert {r.key: r.makespan for r in multi.exact_once(frame, "key", "q", prices).collect()} == want
    sets = [[(key, len(q), m, start + speed * sum(x for j, x in enumerate(q) if m >> j & 1) if m else 0) for key, q in jobs.items() for m in range(1 << len(q))] for start, speed in prices]
    frames = [spark.createDataFrame(pd.DataFrame(s, columns=["key", "n", "mask", "cost"])) for s in sets]
    assert {r.key: r.makespan for r in multi.exact_rounds(frames, "key").collect()} == {k: want[k] for k in jobs}


def test_group_of_job_has_more_partitions_for_more_rows(spark, sf, monkeypatch):
    """A task's share of the rows stays the same: the session's fixed number of partitions let it grow with the tables."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(relational, "TASK_ROWS", 100)
    plan = relational.group_of_job(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {-(-lines // 100)}") >= 3 and relational.partitions(spark, 1) == 4
