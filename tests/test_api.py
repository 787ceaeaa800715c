from __future__ import annotations

import pandas as pd
import pytest

from jobloom import api
from jobloom.plans.multi import Costs, plan_multi


@pytest.fixture
def tables(spark):
    jobs = spark.createDataFrame([(i, 40 + i * 37 % 900, 1 + i % 3) for i in range(60)], "job_id long, tokens long, n_seeds long")
    executors = spark.createDataFrame([(0, 0, 2000, 500_000), (1, 1, 1000, 900_000), (2, 0, 2000, 500_000)], "slot long, kind long, compile_us long, infer_us long")
    return jobs, executors


@pytest.mark.parametrize("policy", ["search", "round_robin"])
def test_each_job_is_placed_once_and_fits(tables, policy):
    jobs, executors = tables
    placed = api.plan(jobs, executors, policy=policy, seeds=2, moves=10)
    rows = placed.collect()
    assert sorted(r.job_id for r in rows) == list(range(60)) and all(r.shape >= r.tokens for r in rows)
    got = api.report(placed, executors).collect()
    assert sum(r.n_jobs for r in got) == 60 and sum(r.n_inf for r in got) == sum(r.n_seeds for r in rows)


def test_search_is_not_slower_than_round_robin(tables):
    jobs, executors = tables

    def makespan(policy):
        loads: dict = {}
        for r in api.report(api.plan(jobs, executors, policy=policy), executors).collect():
            loads[r.slot] = loads.get(r.slot, 0) + r.total_us
        return max(loads.values())

    assert makespan("search") <= makespan("round_robin")
    with pytest.raises(ValueError):
        api.plan(jobs, executors, policy="other")


def test_more_effort_plans_no_worse(tables):
    jobs, executors = tables
    top = [api.report(api.plan(jobs, executors, effort=e), executors).groupBy("slot").agg({"total_us": "sum"}).toDF("slot", "load").agg({"load": "max"}).first()[0] for e in (0, 1, 2)]
    assert top[0] >= top[1] >= top[2] > 0
    with pytest.raises(ValueError):
        api.plan(jobs, executors, effort=3)


def test_execute_sees_jobs_in_order(tables):
    jobs, executors = tables

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"slot": b["slot"], "job_id": b["job_id"], "place": range(len(b))})

    got = api.execute(api.plan(jobs, executors, policy="round_robin"), run, "slot long, job_id long, place long").collect()
    assert len(got) == 60 and len({r.slot for r in got}) == 3


def test_reported_loads_are_the_planned_ones(spark):
    """Compiling is so dear that executors compile few shapes, and jobs run at those."""
    jobs = spark.createDataFrame([(i, 100 + 300 * i, 1 + i % 2) for i in range(12)], "job_id long, tokens long, n_seeds long")
    executors = spark.createDataFrame([(0, 0, 10**9, 500_000), (1, 1, 10**9, 900_000), (2, 0, 10**9, 500_000)], "slot long, kind long, compile_us long, infer_us long")
    t = api.timing_of(jobs)
    placed = api.plan(jobs, executors, seeds=2)
    rows = placed.collect()
    assert sorted(r.job_id for r in rows) == list(range(12)) and all(r.shape >= r.tokens for r in rows)
    got = {r.slot: r.load for r in api.report(placed, executors).groupBy("slot").agg({"total_us": "sum"}).toDF("slot", "load").collect()}
    work = api.W.covered(jobs, t)
    costs = api.W.costs(executors, api.candidate_shapes(jobs, t), t)
    table = {(r.kind, r.shape): (r.compile_cost, r.infer_cost) for r in costs.collect()}
    shapes, kind = sorted({s for _, s in table}), {0: 0, 1: 1, 2: 0}
    cover = {r.job_id: r["shape"] for r in work.collect()}
    for slot, load in got.items():
        own = [r for r in rows if r.slot == slot]
        units = tuple(sum(r.n_seeds for r in own if cover[r.job_id] == s) for s in shapes)
        c = Costs([[table[kind[slot], s][0] for s in shapes]], [[table[kind[slot], s][1] for s in shapes]])
        assert load == c.of(0, units)
    types = work.groupBy("shape", "n_seeds").agg({"*": "count"}).toDF("shape", "n_seeds", "n_jobs")
    planned = {r.slot: r.load for r in plan_multi(types, costs, executors.select("slot", "kind"), 2, 60).collect()}
    assert planned == got


def test_executors_are_chosen_and_checked(tables, spark):
    jobs, executors = tables
    slots = lambda e, **k: {r.slot for r in api.plan(jobs, e, seeds=1, moves=5, **k).collect()}
    assert slots(executors, only=[0, 2]) == {0, 2}
    with pytest.raises(ValueError, match=r"\[7\]"):
        api.plan(jobs, executors, only=[0, 7])
    broken = executors.unionByName(spark.createDataFrame([(3, 3, 10, 0), (4, 4, -1, 5)], executors.schema))
    assert slots(broken) == {0, 1, 2}


def test_a_contaminated_measurement_deals_jobs_one_by_one(tables):
    jobs, executors = tables
    from pyspark.sql import functions as F

    marked = executors.withColumn("contaminated", F.col("slot") == 1)
    planner = api.Planner(jobs, marked)
    meta = planner.metadata().first()
    assert (meta.policy, meta.stage, meta.contaminated, meta.n_jobs) == ("round_robin", "round_robin", True, 60)
    assert sorted(map(tuple, planner.placed().collect())) == sorted(map(tuple, api.plan(jobs, executors, policy="round_robin").collect()))
    assert not api.Planner(jobs, executors.withColumn("contaminated", F.lit(False))).contaminated


def test_metadata_of_a_plan(tables):
    jobs, executors = tables
    planner = api.Planner(jobs, executors, seeds=1, moves=5)
    meta = planner.metadata().first()
    loads = {r.slot: r.load for r in planner.report().groupBy("slot").agg({"total_us": "sum"}).toDF("slot", "load").collect()}
    assert meta.makespan_us == max(loads.values()) >= meta.lower_bound_us > 0
    assert (meta.stage, meta.n_jobs, meta.n_inf) == ("search", 60, sum(r.n_seeds for r in jobs.collect()))
    assert [tuple(x) for x in meta.compiles_per_executor] == sorted((r.slot, r.n) for r in planner.report().groupBy("slot").count().toDF("slot", "n").collect())
