"""Several executors: the least makespan over unequal hardware.

Jobs meet the planner as types (class, seeds, number of jobs), so its input
does not grow with the number of jobs.  Independent searches (one seed each)
are rows, run in parallel, and the best is kept by its sorted loads.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.storage import materialize

INF = 10**18
#: Inputs of at most so many jobs are planned exactly: 3 ** 12 pairs of disjoint sets an executor.
EXACT_JOBS = 12
#: What remembered costs may hold at once, in classes with units (some 70 MB), and halvings of a deadline's interval.
MEMO, HALVINGS = 1 << 19, 10
#: What the moves of one search may cost, in pairs of classes that are looked at.
CELLS = 1_000_000
#: Pairs of sets that are compared side by side.
SPLITS = 1 << 17


class Costs:
    """Least cost of an executor kind for given units by class; memoised.

    Only classes that hold units are looked at: a compiled shape serves a
    stretch of them, and lies below the next one that it does not serve.
    """

    def __init__(self, compile_cost: list[list[int]], infer_cost: list[list[int]]):
        self.compile, self.infer, self.memo, self.held, self.worth, self.cells = compile_cost, infer_cost, {}, 0, {}, 0

    def of(self, kind: int, units: tuple[int, ...]) -> int:
        return self.of_used(kind, [(k, u) for k, u in enumerate(units) if u], len(units))

    def of_used(self, kind: int, used: list[tuple[int, int]], n_classes: int) -> int:
        """The same from the classes that hold units, in order."""
        key = (kind, *used)
        if key not in self.memo:
            self.held += len(used) + 1
            if self.held > MEMO:
                self.memo.clear()
                self.held = len(used) + 1
            best = [0]  # the least cost of the first classes in use
            for b in range(len(used)):
                best.append(self.with_last(kind, used[: b + 1], best, used[b + 1][0] if b + 1 < len(used) else n_classes))
            self.memo[key] = best[-1]
            self.cells += len(used) ** 2
        return self.memo[key]

    def with_last(self, kind: int, used: list[tuple[int, int]], best: list[int], below: int) -> int:
        """The least cost of classes in use, from those of all fewer first ones; the last one's shape is below the given one."""
        at = [(c, i) for s, c, i in self.worthwhile(kind, used[-1][0], len(self.compile[kind])) if s < below]
        upto, least = 0, INF
        for a in range(len(used) - 1, -1, -1):
            upto += used[a][1]
            least = min(least, best[a] + min(c + upto * i for c, i in at))
        return least

    def worthwhile(self, kind: int, first: int, n_classes: int) -> list[tuple[int, int, int]]:
        """(shape, compilation, inference) from a class on, without shapes that a smaller one of these equals or beats in both."""
        if (kind, first) not in self.worth:
            kept: list[tuple[int, int, int]] = []
            for s in range(first, n_classes):
                c, i = self.compile[kind][s], self.infer[kind][s]
                if not any(x <= c and y <= i for _, x, y in kept):
                    kept.append((s, c, i))
            self.worth[kind, first] = kept
        return self.worth[kind, first]


class Counts(Sequence):
    """How many jobs of each type an executor has; only what it has is held, so many executors take little."""

    def __init__(self, n_types: int, own: dict[int, int] | None = None):
        self.n_types, self.own = n_types, {} if own is None else own

    def __len__(self) -> int:
        return self.n_types

    def __getitem__(self, t: int) -> int:
        if not 0 <= t < self.n_types:
            raise IndexError(t)
        return self.own.get(t, 0)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Sequence) and list(self) == list(other)

    def moved(self, t: int, n: int) -> Counts:
        """The same with n more jobs of a type."""
        own = self.own | {t: self[t] + n}
        if not own[t]:
            del own[t]
        return Counts(self.n_types, own)


def held(counts: Sequence[int]) -> list[tuple[int, int]]:
    """(type, number) of the types that an executor has, in order."""
    return sorted(counts.own.items()) if isinstance(counts, Counts) else [(t, n) for t, n in enumerate(counts) if n]


def load(costs: Costs, kind: int, types: list[tuple[int, int, int]], counts: Sequence[int], n_classes: int) -> int:
    units: dict[int, int] = {}
    for t, n in held(counts):
        cls, seeds, _ = types[t]
        units[cls] = units.get(cls, 0) + seeds * n
    return costs.of_used(kind, sorted((k, u) for k, u in units.items() if u), n_classes)


def subset_costs(costs: Costs, kind: int, jobs: list[tuple[int, int]]) -> np.ndarray:
    """The least cost of each set of jobs (class, seeds; by class), a bit a job.

    The last shape of a choice serves a set's jobs from some job on, the shapes
    before it the others, whose cost is known.
    """
    n = len(jobs)
    units = np.zeros(1 << n, np.int64)
    best = np.zeros(1 << n, np.int64)
    for k, (cls, seeds) in enumerate(jobs):
        low = np.arange(1 << k)
        own = low | 1 << k
        units[own] = units[low] + seeds
        shapes = costs.worthwhile(kind, cls, len(costs.compile[kind]))
        least = np.full(1 << k, INF, np.int64)
        for i in range(k + 1):
            rest = low & (1 << i) - 1
            served = units[own] - units[rest]
            at = np.min([c + served * f for _, c, f in shapes], axis=0)
            least = np.minimum(least, best[rest] + at)
        best[own] = least
    return best


def exact(costs: Costs, kinds: list[int], types: list[tuple[int, int, int]], n_classes: int) -> list[list[int]]:
    """A plan of the least makespan, for a few jobs and any number of executors.

    Executors take sets of jobs one after another: the best makespan of all
    jobs in a set over the first executors follows from the sets that the last
    of them may take, and from what is known of the others.
    """
    jobs = [t for t in sorted(range(len(types)), key=lambda t: types[t][:2]) for _ in range(types[t][2])]
    by_kind = {k: subset_costs(costs, k, [types[t][:2] for t in jobs]) for k in set(kinds)}
    size = 1 << len(jobs)
    sets = np.arange(size)
    top, taken = by_kind[kinds[0]], [sets]
    for kind in kinds[1:]:
        own, new, took = by_kind[kind], top.copy(), np.zeros(size, np.int64)
        for mine in range(1, size):
            rest = sets[(sets & mine) == 0]
            with_mine = np.maximum(top[rest], own[mine])
            better = with_mine < new[rest | mine]
            new[rest[better] | mine], took[rest[better] | mine] = with_mine[better], mine
        top = new
        taken.append(took)
    state, left = [[0] * len(types) for _ in kinds], size - 1
    for g in range(len(kinds) - 1, -1, -1):
        mine = int(taken[g][left])
        for bit, t in enumerate(jobs):
            state[g][t] += mine >> bit & 1
        left ^= mine
    return state


def proportional(speeds: list[float], types: list[tuple[int, int, int]]) -> list[Counts]:
    """Each type dealt by speed: executors own stretches of the unit interval, and jobs lie on it evenly.

    The jobs of different types are shifted against each other, so types of a
    single job do not all fall to one executor.
    """
    ends = np.cumsum(speeds) / sum(speeds)
    ends[-1] = 1.0
    state = [Counts(len(types)) for _ in speeds]
    for t, phase in enumerate(np.arange(len(types)) * 0.6180339887498949 % 1.0):
        dealt = np.diff(np.floor(ends * types[t][2] + phase).astype(int), prepend=int(phase))
        for g in np.flatnonzero(dealt).tolist():
            state[g].own[t] = int(dealt[g])
    return state


def contiguous(costs: Costs, kinds: list[int], order: list[int], types: list[tuple[int, int, int]], n_classes: int) -> list[Counts]:
    """Neighbouring classes dealt together, so that each executor compiles few shapes.

    Executors, in the given order, take types in the order of class, each as
    many jobs as it ends by a deadline.  A load never falls when a job is
    added, so the least deadline by which all jobs find a place is bracketed
    by doubling, then halved down to a thousandth.  What an idle executor can
    take of a type by a deadline is worked out once a kind.
    """
    line = sorted(range(len(types)), key=lambda t: types[t][:2])

    def most(kind: int, used: list[tuple[int, int]], best: list[int], seeds: int, left: int, deadline: int) -> int:
        """How many more jobs of the last class end by the deadline, up to ``left``."""
        shapes = costs.worthwhile(kind, used[-1][0], n_classes)
        upto, n = 0, 0
        for a in range(len(used) - 1, -1, -1):
            upto += used[a][1]
            for _, c, i in shapes:
                spare = deadline - best[a] - c
                if spare >= upto * i:
                    n = max(n, (spare // i - upto) // seeds if i * seeds else left)
        return min(n, left)

    def dealt(deadline: int) -> list[Counts] | None:
        state = [Counts(len(types)) for _ in kinds]
        idle: dict[tuple[int, int], int] = {}
        at, left = 0, types[line[0]][2]
        for g in order:
            used: list[tuple[int, int]] = []
            best: list[int] = []  # the least cost of the first classes in use
            while at < len(line):
                cls, seeds, all_ = types[line[at]]
                if used:
                    if used[-1][0] != cls:
                        best.append(costs.with_last(kinds[g], used, best, cls))
                        used.append((cls, 0))
                    n = most(kinds[g], used, best, seeds, left, deadline)
                else:
                    best, used = [0], [(cls, 0)]
                    if (kinds[g], at) not in idle:
                        idle[kinds[g], at] = most(kinds[g], used, best, seeds, all_, deadline)
                    n = min(idle[kinds[g], at], left)
                if n:
                    state[g].own[line[at]] = n
                used[-1] = (cls, used[-1][1] + n * seeds)
                left -= n
                if left:
                    break
                at += 1
                left = types[line[at]][2] if at < len(line) else 0
            if at == len(line):
                return state
        return None

    every = [0] * n_classes
    for cls, seeds, n in types:
        every[cls] += seeds * n
    high = max(1, min(costs.of(k, tuple(every)) for k in set(kinds)) // len(kinds))
    while (found := dealt(high)) is None:
        high *= 2
    low = high // 2
    for _ in range(HALVINGS):
        middle = (low + high) // 2
        if (better := dealt(middle)) is None:
            low = middle
        else:
            high, found = middle, better
    return found


class Moves(Sequence):
    """(type, executor, number): all moves of one executor's jobs to another, each made when it is looked up."""

    def __init__(self, state: list[Sequence[int]], a: int):
        self.a, self.others = a, len(state) - 1
        self.kinds = [(t, [n for n in {1, m // 2, m} if n]) for t, m in held(state[a])]
        self.ends = list(accumulate(len(numbers) * self.others for _, numbers in self.kinds))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, i: int) -> tuple[int, int, int]:
        k = bisect_right(self.ends, i)
        t, numbers = self.kinds[k]
        b, n = divmod(i - (self.ends[k - 1] if k else 0), len(numbers))
        return t, b + (b >= self.a), numbers[n]


def descend(costs: Costs, kinds: list[int], types: list[tuple[int, int, int]], state: list[Sequence[int]], n_classes: int, rng: random.Random, moves: int) -> tuple[list[int], list[Sequence[int]]]:
    """Moves of one type from the most loaded executor to another, kept if the sorted loads fall, up to ``moves`` and ``CELLS``.

    Two moves from one executor change three loads at most, and sorted loads
    compare as those three do.
    """
    state = [c if isinstance(c, Counts) else Counts(len(types), dict(held(c))) for c in state]
    loads = [load(costs, k, types, c, n_classes) for k, c in zip(kinds, state, strict=True)]
    most = costs.cells + CELLS
    falls = lambda new, old: sorted(new, reverse=True) < sorted(old, reverse=True)
    for _ in range(moves):
        if costs.cells > most:
            break
        a = max(range(len(loads)), key=lambda g: (loads[g], -g))
        tried = Moves(state, a)
        better = None
        for t, b, n in rng.sample(tried, min(len(tried), 400)):
            if costs.cells > most:
                break
            la, lb = load(costs, kinds[a], types, state[a].moved(t, -n), n_classes), load(costs, kinds[b], types, state[b].moved(t, n), n_classes)
            if falls((la, lb), (loads[a], loads[b])) if better is None else falls((la, lb, loads[better[1]]), (better[3], better[4], loads[b])):
                better = (t, b, n, la, lb)
        if better is None:
            break
        t, b, n, loads[a], loads[b] = better
        state[a], state[b] = state[a].moved(t, -n), state[b].moved(t, n)
    return loads, state


def best_splits(top: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The least max(top[a], own[b]) over all splits of each set into a and b; a row an instance, a column a set, a bit a job.

    The last job is in neither, in a or in b: three instances of half the size
    each, so 3 ** n pairs are looked at, side by side while they fit ``SPLITS``.
    """
    rows, size = top.shape
    if size == 1:
        return np.maximum(top, own)
    half = size // 2
    parts = [(top[:, :half], own[:, :half]), (top[:, half:], own[:, :half]), (top[:, :half], own[:, half:])]
    if rows * 3 ** (size.bit_length() - 1) <= SPLITS:
        none, first, second = np.split(best_splits(*(np.concatenate(x) for x in zip(*parts, strict=True))), 3)
    else:
        none, first, second = (best_splits(*x) for x in parts)
    return np.concatenate([none, np.minimum(first, second)], axis=1)


def least_tops(costs: list[np.ndarray]) -> np.ndarray:
    """The least makespan of each row's jobs, a round an executor; ``costs`` has what each set of them costs there.

    A round takes what the first executors may have taken with disjoint sets of
    the next one; the last one takes what is left.
    """
    top = costs[0]
    for own in costs[1:-1]:
        top = best_splits(top, own)
    return np.maximum(top, costs[-1][:, ::-1]).min(axis=1) if len(costs) > 1 else top[:, -1]


def exact_rounds(costs: list[DataFrame], key: str) -> DataFrame:
    """(key, makespan): the least makespan of each key's jobs over several executors.

    ``costs`` has a table an executor: (key, n, mask, cost), what each set of
    the key's n jobs costs there, a bit a job.  A key's sets meet in one row:
    there are 2 ** n, and 3 ** n pairs of disjoint ones a round
    (``least_tops``); keys are independent and any number.
    """
    kind = costs[0].schema[key].dataType.simpleString()
    listed, executors = None, len(costs)
    for g, table in enumerate(costs):
        own = table.select(key, F.col("n").cast("int").alias("n"), F.struct(F.lit(g).alias("g"), F.col("mask").cast("bigint").alias("mask"), F.col("cost").cast("bigint").alias("cost")).alias("set"))
        listed = own if listed is None else listed.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for n, sets in zip(batch.column("n").to_pylist(), batch.column("sets"), strict=True):
                every = np.full((executors, 1, 1 << n), INF, np.int64)
                g, mask, cost = (sets.values.field(c).to_numpy() for c in ("g", "mask", "cost"))
                every[g, 0, mask] = cost
                least.append(int(least_tops(list(every))[0]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(least, pa.int64())], [key, "makespan"])

    rows = listed.groupBy(key).agg(F.max("n").alias("n"), F.collect_list("set").alias("sets"))
    return rows.mapInArrow(run, f"{key} {kind}, makespan bigint").filter(F.col("makespan") < INF)


def least_of_loads(sizes: np.ndarray, prices: list[tuple[int, int]]) -> int:
    """The least makespan of positive sizes from the units that all executors but the last can have at once: a cell each, not a deal each."""
    total = int(sizes.sum())
    can = np.zeros((total + 1,) * (len(prices) - 1), bool)
    can[(0,) * can.ndim] = True
    for size in sizes.tolist():
        before = can.copy()
        for axis in range(can.ndim):
            np.moveaxis(can, axis, 0)[size:] |= np.moveaxis(before, axis, 0)[:-size]
    at = np.nonzero(can)
    cost = lambda units, start, speed: np.where(units > 0, start + speed * units, 0)
    return int(np.maximum.reduce([cost(units, *price) for units, price in zip([*at, total - sum(at)], prices, strict=True)]).min())


def exact_once(jobs: DataFrame, key: str, sizes: str, prices: list[tuple[int, int]]) -> DataFrame:
    """(key, makespan): the same for executors that each compile once: ``prices`` (compilation, a unit) an executor.

    ``jobs`` has a row a key with the sizes of its jobs, an array; null sizes
    are no jobs, and a key without jobs has a null makespan.  Where a key has
    many jobs of small sizes, there are fewer loads than deals, and these are
    looked at (``least_of_loads``).
    """
    kind = jobs.schema[key].dataType.simpleString()

    def least(units: np.ndarray) -> np.ndarray:
        sets = np.zeros((len(units), 1), np.int64)
        for k in range(units.shape[1]):
            sets = np.concatenate([sets, sets + units[:, k : k + 1]], axis=1)
        costs = [start + speed * sets for start, speed in prices]
        for cost in costs:
            cost[:, 0] = 0  # the empty set
        return least_tops(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = batch.column(sizes)
            values, ends = arrays.flatten().to_numpy(), np.cumsum(pc.list_value_length(arrays).to_numpy())
            n = np.diff(ends, prepend=0)
            out = np.zeros(len(n), np.int64)
            for size in np.unique(n[n > 0]).tolist():  # rows with as many jobs are looked at together
                at = np.flatnonzero(n == size)
                units = values[(ends[at] - size)[:, None] + np.arange(size)]
                cells = (units.sum(axis=1).astype(float) + 1) ** (len(prices) - 1)
                loads = (units.min(axis=1) > 0) & (cells <= min(8 * 3**size, CELLS))
                out[at[loads]] = [least_of_loads(x, prices) for x in units[loads]]
                at, units = at[~loads], units[~loads]
                wide = max(1, SPLITS >> size)
                for first in range(0, len(at), wide):
                    out[at[first : first + wide]] = least(units[first : first + wide])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, mask=n == 0)], [key, "makespan"])

    units = F.filter(F.coalesce(sizes, F.array().cast("array<bigint>")), lambda x: x.isNotNull()).cast("array<bigint>")
    return jobs.select(key, units.alias(sizes)).mapInArrow(run, f"{key} {kind}, makespan bigint")


def few(types: list[tuple[int, int, int]]) -> bool:
    """Whether there are so few jobs that all deals can be compared."""
    return sum(n for _, _, n in types) <= EXACT_JOBS


def search(costs: Costs, kinds: list[int], types: list[tuple[int, int, int]], n_classes: int, seed: int, moves: int = 60) -> tuple[list[int], list[Sequence[int]]]:
    """(loads, counts by executor and type) of one seeded search.

    Of each four seeds one starts from shares by speed, the others from
    contiguous deals: executors by their ratio of compilation to inference,
    slow ones first, fast ones first.  From the fifth on, speeds and orders vary.
    """
    if few(types):
        state = exact(costs, kinds, types, n_classes)
        return [load(costs, k, types, c, n_classes) for k, c in zip(kinds, state, strict=True)], state
    every = tuple(sum(s * n for c, s, n in types if c == k) for k in range(n_classes))
    rng = random.Random(seed)
    varied = [1.0 if seed < 4 else rng.uniform(0.8, 1.25) for _ in kinds]
    whole = {k: max(costs.of(k, every), 1) for k in set(kinds)}
    if seed % 4 == 1:
        start = proportional([v / whole[k] for k, v in zip(kinds, varied, strict=True)], types)
    else:
        least = {k: sum(costs.compile[k]) / max(sum(costs.infer[k]), 1) for k in set(kinds)}
        rank = {0: lambda k: least[k], 2: lambda k: -whole[k], 3: lambda k: whole[k]}[seed % 4]
        start = contiguous(costs, kinds, sorted(range(len(kinds)), key=lambda g: (rank(kinds[g]) * varied[g], g)), types, n_classes)
    return descend(costs, kinds, types, start, n_classes, rng, moves)


def plan_multi(types: DataFrame, costs: DataFrame, executors: DataFrame, seeds: int = 4, moves: int = 60) -> DataFrame:
    """(slot, shape, n_seeds, n_jobs, load, makespan): jobs of each type on each executor.

    ``types`` (shape, n_seeds, n_jobs), ``costs`` (kind, shape, ...), and
    ``executors`` (slot, kind) are bounded tables; each search gets them whole.
    """
    spark = types.sparkSession
    rows = [sorted(map(tuple, df.collect())) for df in (types.select("shape", "n_seeds", "n_jobs"), costs.select("kind", "shape", "compile_cost", "infer_cost"), executors.select("slot", "kind"))]
    if not rows[0] or not rows[2]:
        return spark.createDataFrame([], "slot long, shape long, n_seeds long, n_jobs long, load long, makespan long")
    shapes = sorted({r[1] for r in rows[1]})
    kinds = sorted({r[0] for r in rows[1]})
    by = {(k, s): (c, i) for k, s, c, i in rows[1]}
    table = ([[by[k, s][0] for s in shapes] for k in kinds], [[by[k, s][1] for s in shapes] for k in kinds])
    coded = [(shapes.index(s), n, m) for s, n, m in rows[0]]
    slots, own = [r[0] for r in rows[2]], [kinds.index(r[1]) for r in rows[2]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for seed in batch["id"]:
                loads, state = search(Costs(*table), own, coded, len(shapes), int(seed), moves)
                key = ",".join(f"{x:019d}" for x in sorted(loads, reverse=True))
                top = max(loads)
                rows = [(int(seed), None, slots[g], shapes[coded[t][0]], coded[t][1], n, loads[g], top) for g, counts in enumerate(state) for t, n in held(counts)]
                rows[0] = (rows[0][0], key, *rows[0][2:])  # the key is as long as there are executors: one row has it
                yield pd.DataFrame(rows, columns=["seed", "key", "slot", "shape", "n_seeds", "n_jobs", "load", "makespan"])

    seeds = 1 if few(coded) or len(slots) == 1 else seeds  # a single answer
    found = spark.range(0, seeds, 1, seeds).mapInPandas(run, "seed long, key string, slot long, shape long, n_seeds long, n_jobs long, load long, makespan long")
    found = materialize(found, "searches")  # a search runs once
    best = found.filter("key is not null").agg(F.min(F.struct("key", "seed"))["seed"].alias("seed"))
    return found.join(F.broadcast(best), "seed").drop("seed", "key")


def share_tails(jobs: DataFrame, compile_cost: Callable[[Column, Column], Column], infer_cost: Callable[[Column, Column], Column]) -> DataFrame:
    """(grp, thief, k, job, shape): the jobs of other executors that each idle executor would take over, in order.

    ``jobs`` (grp, slot, job, tokens, n_seeds, shape), run by shape and then
    job; costs are given by slot and shape.  A thief looks at the last jobs of
    all others, then at those before them, and takes one if it would finish it
    sooner than its owner.  Finish times are running sums; a thief's choices
    are a fold over its ordered candidates, which are a group's jobs.
    """
    run = Window.partitionBy("grp", "slot").orderBy("shape", "job")
    first = F.row_number().over(Window.partitionBy("grp", "slot", "shape").orderBy("job")) == 1
    cost = F.when(first, compile_cost(F.col("slot"), F.col("shape"))).otherwise(0) + F.col("n_seeds") * infer_cost(F.col("slot"), F.col("shape"))
    timed = jobs.withColumn("cost", cost).select("*", F.sum("cost").over(run).alias("finish"), F.row_number().over(Window.partitionBy("grp", "slot").orderBy(F.desc("shape"), F.desc("job"))).alias("depth"))
    one = F.struct("depth", "slot", "job", "tokens", "n_seeds", "shape", "finish")
    listed = timed.groupBy("grp").agg(F.array_sort(F.collect_list(one)).alias("all"))
    thieves = timed.groupBy("grp", F.col("slot").alias("thief")).agg(F.max("finish").alias("free"), F.collect_set("shape").alias("own"))
    start = F.struct(F.col("free").alias("t"), F.col("own").alias("compiled"), F.array().cast("array<struct<job:bigint,shape:bigint>>").alias("taken"))

    def look(s: Column, x: Column) -> Column:
        ready = F.array_min(F.filter(s["compiled"], lambda c: c >= x["tokens"]))
        at = F.coalesce(ready, x["shape"])
        done = s["t"] + F.when(ready.isNull(), compile_cost(F.col("thief"), at)).otherwise(0) + x["n_seeds"] * infer_cost(F.col("thief"), at)
        take = F.struct(done.alias("t"), F.array_union(s["compiled"], F.array(at)).alias("compiled"), F.array_append(s["taken"], F.struct(x["job"].alias("job"), at.alias("shape"))).alias("taken"))
        return F.when((x["slot"] != F.col("thief")) & (done < x["finish"]), take).otherwise(s)

    folded = thieves.join(listed, "grp").select("grp", "thief", F.aggregate("all", start, look, lambda s: s["taken"]).alias("taken"))
    return folded.select("grp", "thief", F.posexplode("taken").alias("k", "x")).select("grp", "thief", F.col("k").cast("bigint").alias("k"), "x.job", "x.shape")
