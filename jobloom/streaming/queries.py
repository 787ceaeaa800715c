"""Queries that run as streams over the given tables, in several micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.operators.extras import latest_state
from jobloom.operators.more import event_tokens
from jobloom.operators.relational import done_distinct
from jobloom.registry import SQL, query, table
from jobloom.storage import discard, materialize, scratch_path
from jobloom.streaming.progress import progress, with_jobs
from jobloom.streaming.sinks import Appended, Upserted, into

FILES = 6


def _run(rows: DataFrame, make, sink: Appended | Upserted) -> None:
    """``make(stream)`` into the sink, the rows arriving in ``FILES`` files, two a micro-batch."""
    spark = rows.sparkSession
    arrived = materialize(rows.repartition(FILES), "arrived")
    stream = spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", 2).parquet(arrived.__dict__["_scratch"])
    started = into(make(stream), sink, scratch_path(spark, "checkpoint"))
    try:
        started.awaitTermination()
    finally:
        started.stop()
        discard(arrived)


@query(SQL[event_tokens.__name__])
def streamed_event_tokens(spark: SparkSession, d: str) -> DataFrame:
    """A stream of events joined to a static table of jobs, under a watermark."""
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("job"), F.nullif(F.col("event_id") % 5, F.lit(0)).alias("tokens"), F.col("ts").cast("timestamp").alias("ts"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.col("c_nationkey").alias("tokens"))
    sink = Appended(scratch_path(spark, "event-tokens"))
    _run(events, lambda s: with_jobs(s, jobs, delay="10 minutes", at="ts").select("event_id", "job", "tokens"), sink)
    return sink.read(spark, "event_id bigint, job bigint, tokens bigint")


@query(SQL[latest_state.__name__])
def streamed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that arrive in batches, upserted by key: the latest stands, with the number it replaces."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_linenumber")
    sink = Upserted(scratch_path(spark, "verdicts"), lines.schema.simpleString()[7:-1].replace(":", " "), ["l_orderkey"], ["l_shipdate", "l_linenumber"], every=2)
    _run(lines, lambda s: s, sink)
    return sink.read(spark).select("l_orderkey", "l_linenumber", F.col("n_rows").alias("n"))


@query(SQL[done_distinct.__name__])
def streamed_done(spark: SparkSession, d: str) -> DataFrame:
    """Distinct finished jobs a slot, from keyed map state: users as slots, kinds of events as jobs."""
    e = table(spark, d, "events")
    logs = e.select(F.col("user_id").cast("string").alias("slot"), F.lit("job_done").alias("event"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_type").alias("job"), F.lit(None).cast("bigint").alias("shape"), F.lit(None).cast("bigint").alias("tokens"))
    sink = Upserted(scratch_path(spark, "done"), "slot string, done bigint", ["slot"], ["done"])
    _run(logs, lambda s: progress(s, None, None).select("slot", "done"), sink)
    return sink.read(spark).select(F.col("slot").cast("bigint").alias("user_id"), F.col("done").alias("kinds"))
