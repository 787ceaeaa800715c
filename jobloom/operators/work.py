"""The planning tables: jobs, executors, shapes and their costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.timing import Timing, default_timing, table_array
from jobloom.registry import table


def default(spark: SparkSession) -> Timing:
    return Timing(table_array(default_timing(spark)))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, tokens, n_seeds) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("job_id"), F.col("n_chars").alias("tokens"), (F.lit(1) + F.col("doc_id") % 5).alias("n_seeds"))


def executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, kind, compile_us, infer_us) from suppliers; executors of one nation are of one kind."""
    kind = F.col("s_nationkey").cast("bigint")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("slot"), kind.alias("kind"), (F.lit(20_000_000) + F.lit(1_000_000) * kind).alias("compile_us"), (F.lit(50_000_000) + F.lit(3_000_000) * (kind % 7)).alias("infer_us")
    )


def kinds(execs: DataFrame) -> DataFrame:
    return execs.select("kind", "compile_us", "infer_us").distinct()


def covered(work: DataFrame, timing: Timing) -> DataFrame:
    """Jobs with the smallest shape that holds each."""
    return work.withColumn("shape", timing.cover(F.col("tokens")))


def units_by_shape(work: DataFrame) -> DataFrame:
    """(shape, units, n_jobs): all that costs depend on, however many jobs there are."""
    return work.groupBy("shape").agg(F.sum("n_seeds").alias("units"), F.count("*").alias("n_jobs"))


def costs(execs: DataFrame, shapes: DataFrame, timing: Timing) -> DataFrame:
    """(kind, shape, compile_cost, infer_cost) for each kind of executor and distinct shape.

    Both sides are distinct values: kinds of hardware, and shapes of a bounded
    ladder, so the product is small however many jobs there are.
    """
    pairs = kinds(execs).crossJoin(F.broadcast(shapes.select("shape").distinct()))
    return pairs.select("kind", "shape", timing.compile_us(F.col("compile_us"), F.col("shape")).alias("compile_cost"), timing.inference_us(F.col("infer_us"), F.col("shape")).alias("infer_cost"))
