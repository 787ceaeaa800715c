"""The engine's surface: scan, plan, execute, expand, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions.timing import Timing, default_timing, table_array
from jobloom.operators import work as W
from jobloom.operators.more import usable
from jobloom.operators.running import row_numbers
from jobloom.plans.multi import EXACT_JOBS, plan_multi
from jobloom.plans.single import candidate_shapes, compiled_shapes, fluid_bound, job_bound, job_class
from jobloom.sources.documents import scan
from jobloom.sources.records import expand, read_records, read_template
from jobloom.sources.writer import DocumentSink
from jobloom.storage import materialize

__all__ = ["Planner", "execute", "expand", "plan", "read_records", "read_template", "report", "scan", "timing_of", "write_documents"]

POLICIES = ("search", "round_robin")
#: Seeded searches and the most moves of each, by effort.
EFFORTS = {0: (1, 10), 1: (4, 60), 2: (16, 400)}


def timing_of(jobs: DataFrame, timing: DataFrame | None = None) -> Timing:
    """Cost expressions of a timing table (bucket, inf, comp), or of the default one."""
    return Timing(table_array(default_timing(jobs.sparkSession) if timing is None else timing))


def dealt(work: DataFrame, slots: DataFrame) -> DataFrame:
    """``work`` (tokens, job_id, ...) with (slot, kind): jobs in the order of size and id, one by one to the executors in theirs."""
    # executors are hardware: a table of bounded size, numbered in one task
    order = slots.select("slot", "kind", (F.row_number().over(Window.orderBy("slot")) - 1).cast("bigint").alias("_ord"))
    n = slots.agg(F.count("*").alias("_n_slots"))
    numbered = row_numbers(work, [], ["tokens", "job_id"], "_n").join(F.broadcast(n))  # one row
    return numbered.withColumn("_ord", (F.col("_n") - 1) % F.col("_n_slots")).join(order, "_ord").drop("_ord", "_n", "_n_slots")


def realised(placed: DataFrame, costs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs at the shapes that their executors compile, and (slot, load, shapes): the cheapest choice of each for its own jobs.

    ``placed`` (slot, kind, shape, n_seeds, ...) has the jobs at their classes,
    ``costs`` (kind, shape, ...) all candidates, also those that no job has.
    """
    loads = placed.groupBy("slot", "kind", "shape").agg(F.sum("n_seeds").alias("units"))
    compiled = materialize(compiled_shapes(loads, costs), "compiled")  # read twice
    at = F.try_element_at(F.filter("shapes", lambda s: s >= F.col("_class")), F.lit(1))
    moved = placed.withColumnRenamed("shape", "_class").join(compiled.select("slot", "shapes"), "slot")
    return moved.withColumn("shape", at).drop("_class", "shapes"), compiled


class Planner:
    """One plan: the jobs' classes, the candidates and their costs, then where each job runs, and what is known of it.

    ``jobs`` (job_id, tokens, n_seeds), ``executors`` (slot, kind, compile_us,
    infer_us, and ``contaminated`` if measured).  ``bucket_mode`` and
    ``buckets`` say which shapes may be compiled (``candidate_shapes``);
    ``only`` picks executors by slot, and an unknown one is an error.
    Executors whose measurement is of no use get no jobs.  If a measurement in
    use is contaminated, speeds are not to be trusted, and jobs are dealt.
    """

    def __init__(self, jobs: DataFrame, executors: DataFrame, timing: DataFrame | None = None, policy: str = "search", seeds: int | None = None, moves: int | None = None, effort: int = 1,
                 bucket_mode: str = "free", buckets: list[int] | None = None, only: list | None = None):
        if effort not in EFFORTS:
            raise ValueError(f"no effort {effort}")
        if policy not in POLICIES:
            raise ValueError(f"no policy {policy}")
        if only is not None:
            known = {r.slot for r in executors.filter(F.col("slot").isin(only)).select("slot").collect()}
            if missing := [x for x in only if x not in known]:
                raise ValueError(f"no executors {missing}")
            executors = executors.filter(F.col("slot").isin(only))
        self.executors = executors.filter(usable(F.col("infer_us"), F.col("compile_us")))
        self.contaminated = "contaminated" in executors.columns and not self.executors.filter("contaminated").isEmpty()
        self.policy, self.effort = "round_robin" if self.contaminated else policy, effort
        self.seeds, self.moves = (x if given is None else given for given, x in zip((seeds, moves), EFFORTS[effort], strict=True))
        self.timing, self.bucket_mode = timing_of(jobs, timing), bucket_mode
        work = jobs.select("job_id", "tokens", "n_seeds")
        self.shapes = materialize(candidate_shapes(work, self.timing, bucket_mode, buckets), "candidates")
        self.work = job_class(work, self.timing, bucket_mode, buckets)
        self.costs = W.costs(self.executors, self.shapes, self.timing)
        self._placed: DataFrame | None = None

    def placed(self) -> DataFrame:
        """(slot, kind, shape, job_id, tokens, n_seeds): each job once, at a shape that its executor compiles."""
        if self._placed is None:
            self._placed = materialize((self._dealt() if self.policy == "round_robin" else self._searched()).select("slot", "kind", "shape", "job_id", "tokens", "n_seeds"), "placed")
        return self._placed

    def _dealt(self) -> DataFrame:
        return dealt(self.work, self.executors.select("slot", "kind"))

    def _searched(self) -> DataFrame:
        types = self.work.groupBy("shape", "n_seeds").agg(F.count("*").alias("n_jobs"))
        slots = self.executors.select("slot", "kind")
        shares = plan_multi(types, self.costs, slots, self.seeds, self.moves)
        by = Window.partitionBy("shape", "n_seeds").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        ranges = shares.select("slot", "shape", "n_seeds", "n_jobs", F.sum("n_jobs").over(by).alias("upto"))
        inside = (F.col("n") > F.col("upto") - F.col("n_jobs")) & (F.col("n") <= F.col("upto"))
        placed = row_numbers(self.work, ["shape", "n_seeds"], ["tokens", "job_id"], "n").join(ranges, ["shape", "n_seeds"]).filter(inside).join(slots, "slot")
        return realised(placed.select("slot", "kind", "shape", "job_id", "tokens", "n_seeds"), self.costs)[0]

    def report(self) -> DataFrame:
        return _report(self.placed(), W.costs(self.executors, self.placed(), self.timing))

    def metadata(self) -> DataFrame:
        """One row: policy, stage, makespan, the bounds no plan can beat, the hardest job at its own class, and compilations an executor."""
        groups = self.report()
        loads = groups.groupBy("slot").agg(F.sum("total_us").alias("load"), F.count("*").alias("compiles"))
        top = loads.agg(F.max("load").alias("makespan_us"), F.sort_array(F.collect_list(F.struct("slot", "compiles"))).alias("compiles_per_executor"))  # a row an executor
        floor = self.work.join(self.costs, "shape").groupBy("job_id").agg(F.min(F.col("compile_cost") + F.col("n_seeds") * F.col("infer_cost")).alias("cost"))
        # of the largest costs the least id; a running maximum, no sort
        hardest = floor.agg(F.max(F.struct("cost")).alias("m")).join(floor, F.col("m.cost") == F.col("cost")).agg(F.max("cost").alias("floor_us"), F.min("job_id").alias("floor_job"))
        bounds = fluid_bound(self.executors, self.work, self.timing, self.shapes).join(job_bound(self.work, self.costs))
        facts = self.work.agg(F.count("*").alias("n_jobs"), F.sum("n_seeds").alias("n_inf"))
        shapes = self.shapes.agg(F.sort_array(F.collect_list("shape")).alias("shapes"))
        one = facts.join(top).join(hardest).join(bounds).join(shapes)  # one row each
        stage = F.lit("round_robin") if self.policy == "round_robin" else F.when(F.col("n_jobs") <= EXACT_JOBS, "exact").otherwise("search")
        return one.select(
            F.lit(self.policy).alias("policy"), F.lit(self.bucket_mode).alias("bucket_mode"), stage.alias("stage"), F.lit(self.effort).alias("effort"), F.lit(self.contaminated).alias("contaminated"),
            "n_jobs", "n_inf", "makespan_us", F.greatest("bound_us", "job_bound_us").alias("lower_bound_us"), "floor_us", "floor_job", "shapes", "compiles_per_executor",
        )





def plan(jobs: DataFrame, executors: DataFrame, timing: DataFrame | None = None, policy: str = "search", seeds: int | None = None, moves: int | None = None, effort: int = 1,
         bucket_mode: str = "free", buckets: list[int] | None = None, only: list | None = None) -> DataFrame:
    """(slot, kind, shape, job_id, tokens, n_seeds): each job once, on one executor.

    ``search`` places types of jobs by seeded searches, then deals each type's
    jobs, in the order of size and id, to the executors' shares; each executor
    compiles the cheapest choice of all candidate shapes for its own jobs, and
    these run at the smallest of them that holds each, so ``report`` gives the
    loads that were planned.  ``effort`` (0, 1, 2) stands for how many searches
    there are and how long each goes on, unless that is given.  ``round_robin``
    deals jobs in that order one by one, each at the smallest candidate that
    holds it.  ``Planner`` has the other arguments, and the plan's metadata.
    """
    return Planner(jobs, executors, timing, policy, seeds, moves, effort, bucket_mode, buckets, only).placed()


def report(placed: DataFrame, executors: DataFrame, timing: DataFrame | None = None) -> DataFrame:
    """(slot, shape, n_jobs, n_inf, total_us): what each executor runs at each shape, compilation included."""
    t = timing_of(placed, timing)
    return _report(placed, W.costs(executors, placed, t))


def _report(placed: DataFrame, costs: DataFrame) -> DataFrame:
    g = placed.groupBy("slot", "kind", "shape").agg(F.count("*").alias("n_jobs"), F.sum("n_seeds").alias("n_inf"))
    cost = F.col("compile_cost") + F.col("n_inf") * F.col("infer_cost")
    return g.join(costs, ["kind", "shape"]).select("slot", "shape", "n_jobs", "n_inf", cost.alias("total_us"))


def execute(placed: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Run ``fn`` over each executor's jobs, in the order of the plan: by shape, then id.

    ``fn`` takes and gives batches, so a queue of any length is never held whole.
    """
    return placed.repartition("slot").sortWithinPartitions("slot", "shape", "job_id").mapInPandas(fn, schema)


def write_documents(expanded: DataFrame, path: str, overwrite: bool = False, strict: bool = False) -> None:
    """Write (name, document) rows as one JSON file each, in a folder a task; wrong records are reported, the others written."""
    expanded.sparkSession.dataSource.register(DocumentSink)
    expanded.write.format("documents").option("path", path).option("strict", str(strict).lower()).mode("overwrite" if overwrite else "append").save()
