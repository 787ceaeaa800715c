"""Queries over the sources' shapes, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.registry import query, table
from jobloom.sources.ledger import flatten, manifests


def _placed(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_suppkey").alias("slot"), F.col("l_linenumber").cast("bigint").alias("shape"), (F.col("l_returnflag") == "R").alias("shared"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("job_id"), F.col("l_partkey").alias("tokens"), F.lit(1).cast("bigint").alias("n_seeds"))


@query("""SELECT slot, ordinal, count(*) AS n_jobs, any_value(shape) AS shape, any_value(shared) AS shared, sum(tokens)::BIGINT AS tokens FROM (
  SELECT l_suppkey AS slot, l_linenumber::BIGINT AS shape, l_returnflag = 'R' AS shared, l_partkey AS tokens,
    dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_returnflag = 'R') - 1 AS ordinal FROM lineitem) GROUP BY slot, ordinal""")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nested manifests, one a slot, built and flattened again."""
    flat = flatten(manifests(_placed(spark, d)))
    return flat.groupBy("slot", F.col("ordinal").cast("bigint").alias("ordinal")).agg(F.count("*").alias("n_jobs"), F.first("shape").alias("shape"), F.first("shared").alias("shared"), F.sum("tokens").alias("tokens"))


@query("""SELECT user_id, max(event_id) AS last_event, count(DISTINCT event_type) FILTER (event_type <> 'error') AS started,
  count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0) AS done FROM events GROUP BY user_id""")
def progress_report(spark: SparkSession, d: str) -> DataFrame:
    """The state that the event stream keeps for each executor, as a batch query."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, d, "events").withColumn("k", k).groupBy("user_id").agg(
        F.max("event_id").alias("last_event"), F.count_distinct(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("started"), F.count_if(F.col("k") % 2 == 0).alias("done")
    )


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Extension: events by hour and type, as the streaming query sums them."""
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
