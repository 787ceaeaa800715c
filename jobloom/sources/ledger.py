"""What a plan leaves on disk: ledger, rejects, manifests; and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "slot long, groups array<struct<shape:long,shared:boolean,jobs:array<struct<job_id:string,tokens:long,n_seeds:long>>>>"


def write_ledger(jobs: DataFrame, rejects: DataFrame, path: str) -> None:
    """Jobs as JSON lines with sorted keys, rejects beside them; both replace what was there."""
    jobs.select(*sorted(jobs.columns)).write.mode("overwrite").json(f"{path}/ledger")
    rejects.write.mode("overwrite").json(f"{path}/rejected")


def manifests(placed: DataFrame) -> DataFrame:
    """(slot, groups) from (slot, shape, shared, job_id, tokens, n_seeds): groups by shape, jobs in order."""
    jobs = placed.groupBy("slot", "shape", "shared").agg(F.array_sort(F.collect_list(F.struct("job_id", "tokens", "n_seeds"))).alias("jobs"))
    return jobs.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("shape", "shared", "jobs"))).alias("groups"))


def write_manifests(placed: DataFrame, path: str) -> None:
    """One folder a slot."""
    manifests(placed).write.mode("overwrite").partitionBy("slot").json(f"{path}/manifests")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(slot, ordinal, shape, shared, job_id, tokens, n_seeds): manifests flattened in run order."""
    return flatten(spark.read.schema(MANIFEST).json(f"{path}/manifests"))


def flatten(nested: DataFrame) -> DataFrame:
    groups = nested.select("slot", F.posexplode("groups").alias("ordinal", "g"))
    return groups.select("slot", "ordinal", "g.shape", "g.shared", F.explode("g.jobs").alias("j")).select("slot", "ordinal", "shape", "shared", "j.*")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Cached probes: malformed ones read as none; derived columns are computed anew."""
    from jobloom.functions.timing import probe_summary

    raw = spark.read.schema("gpu_key string, host string, t_ms array<double>").option("mode", "PERMISSIVE").json(path)
    return raw.filter((F.size("t_ms") == 4) & F.col("gpu_key").isNotNull() & F.forall("t_ms", lambda x: x.isNotNull())).select("gpu_key", "host", "t_ms", probe_summary(F.col("t_ms")).alias("s")).select("gpu_key", "host", "t_ms", "s.*")


MEASUREMENT = "gpu_key string, host string, t_ms array<double>, at double"


def measurement_cache(path: str):
    """The cache of probes: of each key and host the latest clean one stands (``streaming.sinks.Upserted``)."""
    from jobloom.streaming.sinks import Upserted

    return Upserted(path, MEASUREMENT, ["gpu_key", "host"], ["at"])


def cache_measurements(probes: DataFrame, path: str, number: int) -> DataFrame:
    """Write the clean probes (gpu_key, host, t_ms, at) of run ``number``; returns the contaminated ones, which are used in this run only.

    A run that is repeated under its number writes the same again.  Probes
    without a key or without four times are neither.
    """
    from jobloom.functions.timing import probe_summary

    whole = (F.size("t_ms") == 4) & F.col("gpu_key").isNotNull() & F.forall("t_ms", lambda x: x.isNotNull())
    # the condition stands inside too: Spark may summarise before it filters
    summed = probes.filter(whole).withColumn("_s", probe_summary(F.when(whole, F.col("t_ms"))))
    noisy = F.coalesce(F.col("_s.contaminated"), F.lit(True))
    measurement_cache(path).write(summed.filter(~noisy).select("gpu_key", "host", "t_ms", F.col("at").cast("double").alias("at")), number)
    return summed.filter(noisy).select("gpu_key", "host", "t_ms", "at")


def cached_measurements(spark: SparkSession, path: str) -> DataFrame:
    """(gpu_key, host, t_ms, s_ms, r_ms, contaminated): what stands in the cache."""
    from jobloom.functions.timing import probe_summary

    return measurement_cache(path).read(spark).select("gpu_key", "host", "t_ms", probe_summary(F.col("t_ms")).alias("s")).select("gpu_key", "host", "t_ms", "s.*")


def reused_measurements(executors: DataFrame, cached: DataFrame) -> DataFrame:
    """``executors`` (slot, kind, gpu_key, ...) with (s_ms, r_ms, contaminated, origin): their own probe, else one of their kind, else none.

    ``cached`` has one probe a key.  Of a kind the probe of the least slot
    serves the others; executors are hardware, a table of bounded size.
    """
    own = executors.join(cached.select("gpu_key", "s_ms", "r_ms", "contaminated"), "gpu_key", "left")
    sample = own.filter("s_ms is not null").groupBy("kind").agg(F.min(F.struct("slot", "s_ms", "r_ms", "contaminated")).alias("_k"))
    both = own.join(sample, "kind", "left")
    origin = F.when(F.col("s_ms").isNotNull(), "own").when(F.col("_k").isNotNull(), "kind").otherwise("none")
    return both.select(*executors.columns, *(F.coalesce(c, F.col(f"_k.{c}")).alias(c) for c in ("s_ms", "r_ms", "contaminated")), origin.alias("origin"))


def write_rankings(results: DataFrame, path: str) -> None:
    """(job, seed, sample, ranking_score) as CSV with a header, a folder a job, by seed and sample; replaces what was there.

    Sorted within tasks by job, so each task has one file open at a time.
    """
    rows = results.select("job", "seed", "sample", "ranking_score")
    rows.repartitionByRange("job", "seed", "sample").sortWithinPartitions("job", "seed", "sample").write.mode("overwrite").partitionBy("job").csv(f"{path}/rankings", header=True)


def best_results(results: DataFrame) -> DataFrame:
    """(job, seed, sample, ranking_score): the best result of each job; ties go to the first seed and sample, scores that are no numbers come last."""
    score = F.when(F.isnan("ranking_score"), None).otherwise(F.col("ranking_score"))
    first = F.min(F.struct(score.isNull().alias("none"), (-score).alias("down"), "seed", "sample", "ranking_score"))
    return results.groupBy("job").agg(first.alias("b")).select("job", "b.seed", "b.sample", "b.ranking_score")
