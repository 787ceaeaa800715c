"""One executor: which shapes to compile at the least total cost.

The costs depend on the units (job runs) of each class only, so jobs are
summed by class first; what is left is a small table an executor kind, a row a
candidate shape, and the choice is a fold over it, vectorised in its task.

A class is the smallest candidate that holds a job.  Costs need not rise with
the shape, so any candidate from a job's class on may be the one to compile,
also one that is no job's class: plans and bounds look at all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.timing import Timing

#: A cost that stands for "impossible".
INF = 1 << 62
MODES = ("free", "ladder", "list", "tiles")


def candidate_shapes(work: DataFrame, timing: Timing, mode: str = "free", ladder: list[int] | None = None, tile: int = 64, tile_max: int = 5120) -> DataFrame:
    """(shape): the shapes worth compiling for ``work`` (tokens).

    free: table buckets from the least to the largest job's cover; ladder:
    rungs that the table has, and each job's own cover; list: rungs of an
    explicit ladder; tiles: multiples of ``tile``.  Larger jobs get multiples
    of 64, or under ``list`` the largest job's own size.
    """
    if mode not in MODES:
        raise ValueError(f"no bucket mode {mode}")
    spark = work.sparkSession
    if mode in ("free", "ladder"):
        own = work.select(timing.cover(F.col("tokens")).alias("shape")).distinct()
        inside = own.filter(F.col("shape") <= timing.max).agg(F.min("shape").alias("lo"), F.max("shape").alias("hi"))
        listed = spark.range(1).select(F.explode(timing.buckets).alias("shape"))
        if mode == "ladder":
            rungs = spark.createDataFrame([(int(x),) for x in ladder or []], "shape long")
            listed = listed.join(rungs, "shape", "left_semi")
        ranged = listed.join(F.broadcast(inside), F.col("shape").between(F.col("lo"), F.col("hi"))).select("shape")  # one row
        return ranged.union(own).distinct() if mode == "ladder" else ranged.union(own.filter(F.col("shape") > timing.max)).distinct()
    ends = work.agg(F.min("tokens").alias("lo"), F.max("tokens").alias("hi"))
    if mode == "list":
        rungs = F.array(*(F.lit(x).cast("bigint") for x in sorted(ladder or [])))
        up = lambda c: F.coalesce(F.try_element_at(F.filter(rungs, lambda b: b >= c), F.lit(1)), c)
        all_ = F.filter(rungs, lambda b: (b >= up(F.col("lo"))) & (b <= up(F.col("hi"))))
        top = up(F.col("hi"))
    else:
        up = lambda c: F.when(c <= tile_max, F.greatest(F.lit(tile), F.ceil(F.greatest(c, F.lit(1)) / tile) * tile)).otherwise(F.ceil(c / tile) * tile)
        all_ = F.filter(F.sequence(F.lit(tile).cast("bigint"), F.lit(tile_max).cast("bigint"), F.lit(tile).cast("bigint")), lambda b: (b >= up(F.col("lo"))) & (b <= up(F.col("hi"))))
        top = up(F.col("hi"))
    return ends.filter("hi is not null").select(F.explode(F.array_distinct(F.array_append(all_, top))).alias("shape"))


def job_class(work: DataFrame, timing: Timing, mode: str = "free", ladder: list[int] | None = None, tile: int = 64, tile_max: int = 5120) -> DataFrame:
    """``work`` (tokens, ...) with ``shape``, the smallest of its ``candidate_shapes`` that holds each job."""
    if mode in ("free", "ladder"):  # every job's own cover is a candidate
        return work.withColumn("shape", timing.cover(F.col("tokens")))
    top = work.agg(F.max("tokens").alias("_top"))  # one row
    rungs = F.array(*(F.lit(x).cast("bigint") for x in sorted(ladder or []))).cast("array<bigint>")
    if mode == "list":
        shape = F.coalesce(F.try_element_at(F.filter(rungs, lambda b: b >= F.col("tokens")), F.lit(1)), F.col("_top"))
    else:
        up = lambda c: F.ceil(F.greatest(c, F.lit(1)) / tile) * tile
        shape = F.when(F.col("tokens") <= tile_max, up(F.col("tokens"))).otherwise(up(F.col("_top")))
    return work.join(F.broadcast(top)).withColumn("shape", shape.cast("bigint")).drop("_top")


def best_choice(shapes: np.ndarray, upto: np.ndarray, compile_cost: np.ndarray, infer_cost: np.ndarray) -> tuple[int, list[int]]:
    """(cost, shapes) of the cheapest choice among ascending shapes; ``upto`` counts the units of all jobs that fit.

    For each shape the least cost of a choice that ends there, from those that
    end before it; ties go to the fewer, then the smaller shapes.
    """
    if not len(upto) or upto[-1] <= 0:
        return 0, []
    if int(upto[-1]) * int(infer_cost.max()) + int(compile_cost.astype(object).sum()) >= INF:
        upto, compile_cost, infer_cost = (x.astype(object) for x in (upto, compile_cost, infer_cost))  # beyond a long: whole numbers of any size
    n = len(upto)
    cost, before = np.full(n, INF, upto.dtype), np.full(n, -1)
    some = upto > 0
    cost[some] = compile_cost[some] + upto[some] * infer_cost[some]
    for j in np.flatnonzero(some):
        i = np.flatnonzero(some[:j] & (upto[:j] < upto[j]))
        if len(i):
            via = cost[i] + compile_cost[j] + (upto[j] - upto[i]) * infer_cost[j]
            k = int(np.argmin(via))
            if via[k] < cost[j]:
                cost[j], before[j] = via[k], i[k]
    ends = np.flatnonzero(upto == upto[-1])
    at = int(ends[np.argmin(cost[ends])])
    total, chosen = int(cost[at]), []
    while at >= 0:
        chosen.append(int(shapes[at]))
        at = int(before[at])
    return total, chosen[::-1]


def cheapest_choices(rows: DataFrame, key: str) -> DataFrame:
    """(key, cost_us, shapes) from (key, shape, upto, compile_cost, infer_cost): a row a candidate, so a group is a bounded table."""

    def fold(table: pa.Table) -> pa.Table:
        order = np.argsort(table["shape"].to_numpy())
        cost, chosen = best_choice(*(table[c].to_numpy()[order] for c in ("shape", "upto", "compile_cost", "infer_cost")))
        return pa.table({key: table[key].slice(0, 1), "cost_us": pa.array([cost], pa.int64()), "shapes": pa.array([chosen], pa.list_(pa.int64()))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *(F.col(c).cast("bigint") for c in ("shape", "upto", "compile_cost", "infer_cost"))).groupBy(key).applyInArrow(fold, f"{key} {kind}, cost_us bigint, shapes array<bigint>")


def plan_single(units: DataFrame, shapes: DataFrame, costs: DataFrame) -> DataFrame:
    """(kind, cost_us, shapes) for each kind of executor.

    ``units`` (shape, units) by class, ``shapes`` the candidates, ``costs``
    (kind, shape, compile_cost, infer_cost) of the candidates.  There is one
    row a candidate and kind: a bounded table, whatever the number of jobs.
    """
    upto = F.sum(F.coalesce("units", F.lit(0))).over(Window.orderBy("shape"))
    hist = shapes.join(units.select("shape", "units"), "shape", "left").select("shape", upto.alias("upto"))
    return cheapest_choices(costs.join(hist, "shape"), "kind")


def groups(units: DataFrame, plan: DataFrame) -> DataFrame:
    """(kind, shape, n_jobs, n_inf): the plan's compiled shapes with the jobs that run at each."""
    chosen = plan.select("kind", "shapes")
    placed = units.crossJoin(F.broadcast(chosen)).withColumn("at", F.try_element_at(F.filter("shapes", lambda s: s >= F.col("shape")), F.lit(1)))
    return placed.groupBy("kind", F.col("at").alias("shape")).agg(F.sum("n_jobs").alias("n_jobs"), F.sum("units").alias("n_inf"))


def worthwhile(costs: DataFrame) -> DataFrame:
    """(kind, shape, options): of each shape those from it on that no smaller one of these equals or beats in both costs, in order.

    A shape that is left out would serve the same jobs as the smaller one, and
    not cheaper.  A group is a kind's candidates, a bounded table.
    """
    costs = costs.select("kind", *(F.col(c).cast("bigint") for c in ("shape", "compile_cost", "infer_cost")))
    kind = costs.schema["kind"].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("shape", "compile_cost", "infer_cost")), strict=True), reverse=True)
        kept, lists = [], []
        for s, c, i in rows:
            kept = [(s, c, i), *((x, y, z) for x, y, z in kept if y < c or z < i)]
            lists.append([{"shape": x, "compile_cost": y, "infer_cost": z} for x, y, z in kept])
        option = pa.struct([(c, pa.int64()) for c in ("shape", "compile_cost", "infer_cost")])
        return pa.table({"kind": pa.concat_arrays(table["kind"].slice(0, 1).chunks * len(rows)), "shape": pa.array([s for s, _, _ in rows], pa.int64()), "options": pa.array(lists, pa.list_(option))})

    return costs.groupBy("kind").applyInArrow(fold, f"kind {kind}, shape bigint, options array<struct<shape:bigint,compile_cost:bigint,infer_cost:bigint>>")


def compiled_shapes(loads: DataFrame, costs: DataFrame) -> DataFrame:
    """(slot, load, shapes): the cheapest shapes for each executor to compile, and what its jobs then cost.

    ``loads`` (slot, kind, shape, units) are the units placed on each executor
    by class.  Any shape with costs is a candidate; an executor's table has the
    ``worthwhile`` ones between each of its classes and the next, so many
    executors of few jobs each take little.
    """
    own = loads.groupBy("slot", "kind", "shape").agg(F.sum("units").alias("units")).join(F.broadcast(worthwhile(costs)), ["kind", "shape"])
    run = Window.partitionBy("slot").orderBy("shape")
    upto = F.sum(F.coalesce("units", F.lit(0))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    below = F.lead("shape").over(run)
    classes = own.select("slot", upto.alias("upto"), below.alias("below"), "options")
    options = classes.select("slot", "upto", F.explode(F.filter("options", lambda o: F.col("below").isNull() | (o["shape"] < F.col("below")))).alias("o"))
    return cheapest_choices(options.select("slot", "o.*", "upto"), "slot").withColumnRenamed("cost_us", "load")


#: The reference inference time of the fluid bound's executor, in microseconds.
BOUND_US = 10**9


def fluid_bound(executors: DataFrame, work: DataFrame, timing: Timing, shapes: DataFrame | None = None) -> DataFrame:
    """(bound_us): no plan of ``work`` (tokens, n_seeds) over ``executors`` is faster, whichever of the ``shapes`` it compiles.

    All executors are one of their total speed, with the least ratio of
    compilation to inference among them, and jobs may be split.  ``shapes`` are
    the candidates of ``work``, whose column ``shape`` is then each job's class;
    by default those of mode "free".
    """
    classed = work if shapes is not None else job_class(work, timing)
    shapes = candidate_shapes(work, timing) if shapes is None else shapes
    ends = executors.agg(F.min(F.col("compile_us").cast("double") / F.col("infer_us")).alias("rho"), F.sum(F.lit(1.0) / F.col("infer_us")).alias("inv"))
    units = classed.groupBy("shape").agg(F.sum("n_seeds").alias("units"))
    one = shapes.select("shape").join(F.broadcast(ends))  # one row
    costs = one.select(F.lit(0).alias("kind"), "shape", timing.compile_us(F.round(F.col("rho") * BOUND_US).cast("bigint"), F.col("shape")).alias("compile_cost"), timing.inference_us(F.lit(BOUND_US).cast("bigint"), F.col("shape")).alias("infer_cost"))
    loads = units.select(F.lit(0).alias("slot"), F.lit(0).alias("kind"), "shape", "units")
    least = compiled_shapes(loads, costs).select("load")
    return least.join(F.broadcast(ends)).select(F.floor(F.col("load") / (F.lit(float(BOUND_US)) * F.col("inv")) * (1 - 1e-5)).cast("bigint").alias("bound_us"))


def job_bound(classed: DataFrame, costs: DataFrame) -> DataFrame:
    """(job_bound_us): no plan is faster than its hardest job on the best executor, at any candidate that holds it.

    ``classed`` (shape, n_seeds), ``costs`` (kind, shape, ...) of all candidates
    on usable executors.  The hardest job of each class meets the costs from
    its class upwards: both are bounded tables.
    """
    hardest = classed.groupBy("shape").agg(F.max("n_seeds").alias("n_seeds"))
    at = costs.select(F.col("shape").alias("at"), "compile_cost", "infer_cost").distinct()
    runs = hardest.join(at, F.col("at") >= F.col("shape"))
    best = runs.groupBy("shape", "n_seeds").agg(F.min(F.col("compile_cost") + F.col("n_seeds") * F.col("infer_cost")).alias("cost"))
    return best.agg(F.max("cost").alias("job_bound_us"))
