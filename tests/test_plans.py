from __future__ import annotations

import itertools
import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.functions.timing import Timing, default_timing, table_array
from jobloom.operators import work as W
from jobloom.plans import multi, single


def cheapest(shapes, units, comp, inf):
    """Every subset of shapes that holds the largest job; first wins."""
    top, best = max(s for s, u in zip(shapes, units, strict=True) if u), None
    for k in range(1, len(shapes) + 1):
        for pick in itertools.combinations(range(len(shapes)), k):
            if shapes[pick[-1]] < top:
                continue
            cost, lo = 0, -1
            for p in pick:
                n = sum(units[lo + 1 : p + 1])
                cost += comp[p] + n * inf[p]
                if not n:
                    break
                lo = p
            else:
                best = cost if best is None else min(best, cost)
    return best


def test_single_plan_matches_brute_force(spark):
    rnd = random.Random(2)
    cases = []
    for k in range(25):
        shapes = sorted(rnd.sample(range(64, 2000, 64), rnd.randint(1, 6)))
        units = [rnd.choice([0, rnd.randint(1, 20)]) for _ in shapes]
        units[rnd.randrange(len(units))] = 3
        comp, inf = [rnd.randint(0, 300) for _ in shapes], [rnd.randint(1, 40) for _ in shapes]
        cases.append((k, shapes, units, comp, inf))
    rows = [(k, s, sum(u[: i + 1]), c, f) for k, ss, u, cs, fs in cases for i, (s, c, f) in enumerate(zip(ss, cs, fs, strict=True))]
    df = spark.createDataFrame(rows, "kind long, shape long, upto long, compile_cost long, infer_cost long")
    got = {r.kind: r for r in single.cheapest_choices(df, "kind").collect()}
    for k, shapes, units, comp, inf in cases:
        assert got[k].cost_us == cheapest(shapes, units, comp, inf)
        lo, cost = 0, 0
        for s in got[k].shapes:
            n = sum(u for x, u in zip(shapes, units, strict=True) if lo < x <= s)
            cost += comp[shapes.index(s)] + n * inf[shapes.index(s)]
            lo = s
        assert cost == got[k].cost_us


def test_costs_object_agrees_with_the_fold():
    rnd = random.Random(3)
    for _ in range(60):
        n = rnd.randint(1, 6)
        comp, inf = [rnd.randint(0, 300) for _ in range(n)], [rnd.randint(1, 40) for _ in range(n)]
        units = [rnd.choice([0, rnd.randint(1, 9)]) for _ in range(n)]
        if any(units):
            assert multi.Costs([comp], [inf]).of(0, tuple(units)) == cheapest(list(range(1, n + 1)), units, comp, inf)


def instance(rnd, jobs, execs):
    n = 4
    comp = [[rnd.randint(0, 200) for _ in range(n)] for _ in range(2)]
    inf = [sorted(rnd.randint(5, 60) for _ in range(n)) for _ in range(2)]
    types = {}
    for _ in range(jobs):
        t = (rnd.randrange(n), rnd.choice([1, 1, 5]))
        types[t] = types.get(t, 0) + 1
    return multi.Costs(comp, inf), [rnd.randrange(2) for _ in range(execs)], [(*t, m) for t, m in sorted(types.items())], n


def test_exact_makespan_matches_enumeration():
    rnd = random.Random(8)
    for _ in range(15):
        costs, kinds, types, n = instance(rnd, rnd.randint(1, 6), 2)
        jobs = [t for t, (_, _, m) in enumerate(types) for _ in range(m)]
        best = min(
            max(multi.load(costs, k, types, [sum(1 for j, g in zip(jobs, deal, strict=True) if j == t and g == e) for t in range(len(types))], n) for e, k in enumerate(kinds))
            for deal in itertools.product(range(2), repeat=len(jobs))
        )
        state = multi.exact(costs, kinds, types, n)
        assert max(multi.load(costs, k, types, c, n) for k, c in zip(kinds, state, strict=True)) == best
        assert [sum(c[t] for c in state) for t in range(len(types))] == [m for _, _, m in types]


def test_search_keeps_all_jobs_and_improves_its_seed():
    rnd = random.Random(9)
    for _ in range(10):
        costs, kinds, types, n = instance(rnd, 60, 3)
        speeds = [1.0] * 3
        first = max(multi.load(costs, k, types, c, n) for k, c in zip(kinds, multi.proportional(speeds, types), strict=True))
        loads, state = multi.descend(costs, kinds, types, multi.proportional(speeds, types), n, random.Random(0), 60)
        assert max(loads) <= first and [sum(c[t] for c in state) for t in range(len(types))] == [m for _, _, m in types]
        assert multi.search(costs, kinds, types, n, 1) == multi.search(costs, kinds, types, n, 1)


def test_contiguous_deals_are_the_best_of_their_order():
    """Whole jobs in the order of class, cut between executors: no cut is more than a thousandth better."""
    rnd = random.Random(10)
    for _ in range(20):
        costs, kinds, types, n = instance(rnd, rnd.randint(3, 9), 3)
        order = rnd.sample(range(3), 3)
        state = multi.contiguous(costs, kinds, order, types, n)
        assert [sum(c[t] for c in state) for t in range(len(types))] == [m for _, _, m in types]
        line = [t for t, (_, _, m) in enumerate(types) for _ in range(m)]
        best = min(
            max(multi.load(costs, kinds[g], types, [part.count(t) for t in range(len(types))], n) for g, part in zip(order, (line[:a], line[a:b], line[b:]), strict=True))
            for a in range(len(line) + 1)
            for b in range(a, len(line) + 1)
        )
        got = max(multi.load(costs, k, types, c, n) for k, c in zip(kinds, state, strict=True))
        assert best <= got <= best * 1.002 + 1


def test_search_meets_the_bound_on_four_executors(spark):
    """300 jobs over shapes as fine as the table's: at most a fifth above the fluid bound."""
    from jobloom import api

    rnd = random.Random(11)
    jobs = spark.createDataFrame([(i, rnd.randint(60, 3000), rnd.randint(1, 5)) for i in range(300)], "job_id long, tokens long, n_seeds long")
    executors = spark.createDataFrame([(k, k % 2, 20_000_000, 50_000_000 * (1 + k % 2)) for k in range(4)], "slot long, kind long, compile_us long, infer_us long")
    bound = single.fluid_bound(executors, jobs, api.timing_of(jobs)).first().bound_us
    got = api.report(api.plan(jobs, executors), executors).groupBy("slot").agg(F.sum("total_us").alias("load")).agg(F.max("load")).first()[0]
    assert 0 < bound <= got <= 1.2 * bound


def test_plan_multi_lies_between_bounds(spark, sf):
    t = Timing(table_array(default_timing(spark)))
    execs = W.executors(spark, sf)
    jobs = W.covered(W.jobs(spark, sf).filter("tokens <= 2048"), t)
    types = jobs.groupBy((F.ceil(F.col("shape") / 512) * 512).alias("shape"), "n_seeds").agg(F.count("*").alias("n_jobs"))
    costs = W.costs(execs, types, t)
    got = multi.plan_multi(types, costs, execs, seeds=2, moves=20).collect()
    assert sum(r.n_jobs for r in got) == jobs.count()
    assert len({r.makespan for r in got}) == 1 and max(r.load for r in got) == got[0].makespan
    rows = costs.collect()
    hardest = max(min(c.compile_cost + r.n_seeds * c.infer_cost for c in rows if c.shape >= r.shape) for r in types.collect())
    assert got[0].makespan >= hardest


def test_exact_plans_of_many_executors(spark):
    """Twelve jobs on eight executors: no worse than a search, all jobs placed, in little time; equal to enumeration on three."""
    rnd = random.Random(12)
    for _ in range(4):
        costs, kinds, types, n = instance(rnd, 12, 8)
        began = time.process_time()
        state = multi.exact(costs, kinds, types, n)
        assert time.process_time() - began < 4
        top = max(multi.load(costs, k, types, c, n) for k, c in zip(kinds, state, strict=True))
        loads, _ = multi.descend(costs, kinds, types, multi.proportional([1.0] * 8, types), n, random.Random(0), 60)
        assert top <= max(loads) and [sum(c[t] for c in state) for t in range(len(types))] == [m for _, _, m in types]
    for _ in range(8):
        costs, kinds, types, n = instance(rnd, rnd.randint(1, 6), 3)
        jobs = [t for t, (_, _, m) in enumerate(types) for _ in range(m)]
        price = lambda deal: max(multi.load(costs, k, types, [sum(1 for j, g in zip(jobs, deal, strict=True) if (j, g) == (t, e)) for t in range(len(types))], n) for e, k in enumerate(kinds))  # noqa: B023, E731
        state = multi.exact(costs, kinds, types, n)
        assert max(multi.load(costs, k, types, c, n) for k, c in zip(kinds, state, strict=True)) == min(map(price, itertools.product(range(3), repeat=len(jobs))))


def test_subset_costs_equal_the_fold():
    rnd = random.Random(13)
    for _ in range(10):
        costs, _, types, n = instance(rnd, 7, 1)
        jobs = [(c, s) for c, s, m in types for _ in range(m)]
        got = multi.subset_costs(costs, 0, jobs)
        for mask in range(1 << len(jobs)):
            units = [0] * n
            for b, (c, s) in enumerate(jobs):
                units[c] += s * (mask >> b & 1)
            assert got[mask] == costs.of(0, tuple(units))


def test_proportional_deals_whole_types_by_speed():
    state = multi.proportional([3.0, 1.0, 0.5], [(0, 1, 900), (1, 1, 1), (2, 5, 1), (3, 1, 0), (4, 2, 7)])
    assert [sum(c) for c in zip(*state, strict=True)] == [900, 1, 1, 0, 7]
    assert [c[0] for c in state] == [600, 200, 100] and min(map(min, state)) >= 0


def test_executors_look_at_worthwhile_candidates(spark):
    """The same choice as among all candidates, ties and zero units included, from a few rows an executor."""
    rnd = random.Random(15)
    shapes = list(range(1, 61))
    costs = [(k, s, rnd.choice((0, 5, 10, 20)), s * 3 + rnd.choice((0, 0, 2, 7))) for k in range(2) for s in shapes]
    loads = [(slot, slot % 2, s, rnd.randint(0, 3)) for slot in range(30) for s in rnd.sample(shapes, rnd.randint(1, 9))]
    costs_df = spark.createDataFrame(costs, "kind long, shape long, compile_cost long, infer_cost long")
    loads_df = spark.createDataFrame(loads, "slot long, kind long, shape long, units long")
    want = {}
    for slot in range(30):
        units = {s: u for g, _, s, u in loads if g == slot}
        mine = [(s, c, i) for k, s, c, i in costs if k == slot % 2]
        table = np.array([(s, sum(u for x, u in units.items() if x <= s), c, i) for s, c, i in mine], np.int64).T
        want[slot] = single.best_choice(*table)
    assert {r.slot: (r.load, r.shapes) for r in single.compiled_shapes(loads_df, costs_df).collect()} == want
    worth = single.worthwhile(costs_df).selectExpr("max(size(options)) as n").first().n
    assert worth < 20


def test_searches_over_many_executors_take_little():
    """4,000 executors and 400 types: what no executor has takes no place, and moves are not listed."""
    rnd = random.Random(14)
    n = 40
    comp = [[rnd.randint(0, 50) for _ in range(n)] for _ in range(3)]
    inf = [sorted(rnd.randint(5, 60) for _ in range(n)) for _ in range(3)]
    kinds = [g % 3 for g in range(4000)]
    types = [(c, s, 10 + 3 * s) for c in range(n) for s in range(1, 11)]
    for seed in (1, 2):
        tracemalloc.start()
        loads, state = multi.search(multi.Costs(comp, inf), kinds, types, n, seed, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 16e6  # a number for each executor and type: over 40 MB
        assert [sum(x) for x in zip(*state, strict=True)] == [m for _, _, m in types]
        assert loads == [multi.load(multi.Costs(comp, inf), k, types, list(c), n) for k, c in zip(kinds, state, strict=True)]


def test_moves_are_the_listed_ones():
    state = [[0, 5, 1], [2, 0, 0], [1, 0, 8]]
    for a in range(3):
        listed = [(t, b, n) for t in range(3) if state[a][t] for b in range(3) if b != a for n in {1, state[a][t] // 2, state[a][t]} if n]
        assert list(multi.Moves(state, a)) == listed


def test_a_shape_that_no_job_has_may_be_the_cheapest(spark):
    """Costs need not rise with the shape: the plan compiles 76 for a job of 72, and both bounds stay below it."""
    from jobloom import api

    timing = spark.createDataFrame([(72, 1.0, 1.2), (76, 1.01, 0.9), (1024, 5.0, 1.0)], "bucket long, inf double, comp double")
    jobs = spark.createDataFrame([("a", 72, 1), ("b", 76, 1)], "job_id string, tokens long, n_seeds long")
    executors = spark.createDataFrame([(0, 0, 80_000_000, 1_000), (1, 0, 80_000_000, 1_000)], "slot long, kind long, compile_us long, infer_us long")
    for work in (jobs, jobs.filter("job_id = 'a'").unionByName(jobs.filter("job_id = 'b'").withColumn("n_seeds", F.lit(3).cast("long")))):
        for policy, many in (("search", 2), ("search", 1)):
            planner = api.Planner(work, executors.filter(F.col("slot") < many), timing, policy)
            placed = planner.placed().collect()
            assert {r.job_id: r["shape"] for r in placed} == {"a": 76, "b": 76}
            meta = planner.metadata().first()
            assert 0 < meta.lower_bound_us <= meta.makespan_us
            assert meta.floor_us >= 72_001_010 and meta.stage == "exact"
    t = api.timing_of(jobs, timing)
    only = jobs.filter("job_id = 'a'")
    classed, shapes = single.job_class(only, t, "list", [72, 76]), single.candidate_shapes(jobs, t)
    costs = W.costs(executors, shapes, t)
    assert single.job_bound(classed, costs).first().job_bound_us == 72_001_010
    assert single.fluid_bound(executors.limit(1), classed, t, shapes).first().bound_us <= 72_001_010
    placed, loads = api.realised(classed.withColumn("slot", F.lit(0)).withColumn("kind", F.lit(0)), costs)
    assert loads.first().load == 72_001_010 and placed.first()["shape"] == 76


@pytest.mark.parametrize(("mode", "ladder"), [("free", None), ("ladder", [256, 512, 4096]), ("list", [100, 700, 900]), ("tiles", None)])
def test_classes_are_the_smallest_candidates(spark, mode, ladder):
    from jobloom import api

    jobs = spark.createDataFrame([(i, n, 1) for i, n in enumerate([1, 64, 65, 100, 101, 513, 899, 901, 4999, 5120, 5121, 9000])], "job_id long, tokens long, n_seeds long")
    for work in (jobs, jobs.filter("tokens <= 600"), jobs.filter("tokens > 5120"), jobs.filter("tokens < 0")):
        t = api.timing_of(jobs)
        shapes = sorted(r["shape"] for r in single.candidate_shapes(work, t, mode, ladder).collect())
        for r in single.job_class(work, t, mode, ladder).collect():
            assert r["shape"] == min(s for s in shapes if s >= r.tokens)
    with pytest.raises(ValueError, match="no bucket mode"):
        single.candidate_shapes(jobs, t, "other")


def test_bounds_hold_and_plans_are_near_on_tables_that_are_not_monotone(spark):
    from jobloom import api

    rnd = random.Random(14)
    for trial in range(3):
        timing = spark.createDataFrame([(b, rnd.uniform(0.5, 1.5) * b / 1024, rnd.uniform(0.5, 1.5)) for b in range(64, 1088, 64)], "bucket long, inf double, comp double")
        jobs = spark.createDataFrame([(i, rnd.randint(1, 1300), rnd.randint(1, 5)) for i in range(rnd.randint(3, 40))], "job_id long, tokens long, n_seeds long")
        executors = spark.createDataFrame([(k, k % 2, rnd.randint(0, 10**7), 10**6 * (1 + k % 2)) for k in range(3)], "slot long, kind long, compile_us long, infer_us long")
        kinds = executors.groupBy("kind").agg(F.first("compile_us").alias("compile_us"))
        executors = executors.drop("compile_us").join(kinds, "kind")
        meta = api.Planner(jobs, executors, timing, seeds=2, bucket_mode=("free", "tiles", "list")[trial], buckets=[300, 800]).metadata().first()
        assert 0 < meta.lower_bound_us <= meta.makespan_us <= 3 * meta.lower_bound_us


def test_no_plan_is_below_the_fluid_bound(spark):
    from jobloom import api

    jobs = spark.createDataFrame([(i, 100 + 37 * i % 1500, 1 + i % 3) for i in range(30)], "job_id long, tokens long, n_seeds long")
    executors = spark.createDataFrame([(k, k % 2, 10**7 * (1 + k % 2), 500_000 * (1 + k % 2)) for k in range(3)], "slot long, kind long, compile_us long, infer_us long")
    bound = single.fluid_bound(executors, jobs, api.timing_of(jobs)).first().bound_us
    got = api.report(api.plan(jobs, executors, seeds=2), executors).groupBy("slot").agg(F.sum("total_us").alias("load")).agg(F.max("load")).first()[0]
    assert 0 < bound <= got <= 2 * bound


def plain_steals(queues, compile_cost, infer_cost):
    """The rule read off step by step: finish times, then candidates from the tails inwards."""
    finish, end = {}, {}
    for slot, q in queues.items():
        now = 0
        for i, (job, tokens, seeds, shape) in enumerate(q):
            now += seeds * infer_cost(slot, shape) + (0 if any(x[3] == shape for x in q[:i]) else compile_cost(slot, shape))
            finish[job] = end[slot] = now
    out = []
    for thief, q in queues.items():
        ready, now, k = {x[3] for x in q}, end[thief], 0
        for depth in range(1, 1 + max(map(len, queues.values()))):
            for slot in sorted(queues):
                if slot == thief or depth > len(queues[slot]):
                    continue
                job, tokens, seeds, shape = queues[slot][-depth]
                fits = [s for s in ready if s >= tokens]
                at = min(fits) if fits else shape
                then = now + seeds * infer_cost(thief, at) + (0 if fits else compile_cost(thief, at))
                if then < finish[job]:
                    out.append((thief, k, job, at))
                    now, k = then, k + 1
                    ready.add(at)
    return sorted(out)


def test_shared_tails_match_the_rule(spark):
    rnd = random.Random(4)
    comp, inf = (lambda slot, _: 50 * (slot + 1)), (lambda slot, shape: shape * (slot + 1))
    rows, want = [], []
    for grp in range(12):
        jobs = sorted((rnd.randrange(3), (shape := rnd.choice([64, 128, 256])), grp * 100 + j, shape - rnd.randint(0, 60), rnd.randint(1, 6)) for j in range(rnd.randint(1, 14)))
        queues = {}
        for slot, shape, job, tokens, seeds in jobs:
            rows.append((grp, slot, job, tokens, seeds, shape))
            queues.setdefault(slot, []).append((job, tokens, seeds, shape))
        want += [(grp, *x) for x in plain_steals(queues, comp, inf)]
    df = spark.createDataFrame(rows, "grp long, slot long, job long, tokens long, n_seeds long, shape long")
    assert sorted(map(tuple, multi.share_tails(df, comp, inf).collect())) == want and want


@pytest.mark.parametrize(("tokens", "want"), [(1, 64), (64, 64), (65, 128), (5120, 5120), (5121, 5184)])
def test_cover(spark, tokens, want):
    t = Timing(table_array(default_timing(spark)))
    assert spark.range(1).select(t.cover(F.lit(tokens).cast("long")).alias("s")).first().s == want
