"""Further operators of the planning pipeline: leases, cache keys, orders, bounds, state upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions import scalars as S
from jobloom.functions.timing import SQL as PRELUDE
from jobloom.operators import work as W
from jobloom.operators.expressions import _LADDER_SQL, ladder
from jobloom.registry import query, table

STALE_SECONDS = 3600
GRACE_SECONDS = 5


def reclaimable(heartbeat: Column, now: Column, readable: Column, stale: int = STALE_SECONDS) -> Column:
    """Whether a lock may be taken over: stale, or unreadable for longer than a short grace."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(heartbeat.cast("timestamp"))
    return (age > stale * 1_000_000) | (~readable & (age > min(stale, GRACE_SECONDS) * 1_000_000))


@query(f"""SELECT event_id, age > {STALE_SECONDS * 1_000_000} OR (NOT json_valid(props) AND age > {GRACE_SECONDS * 1_000_000}) AS free
FROM (SELECT event_id, props, epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) AS age FROM events)""")
def reclaimable_locks(spark: SparkSession, d: str) -> DataFrame:
    """Locks by their last heartbeat, seen at the time of the latest one (one row)."""
    e = table(spark, d, "events").select("event_id", "ts", F.coalesce(F.try_parse_json("props").isNotNull(), F.lit(False)).alias("readable"))
    now = table(spark, d, "events").agg(F.max("ts").alias("now"))
    return e.join(F.broadcast(now)).select("event_id", reclaimable(F.col("ts"), F.col("now"), F.col("readable")).alias("free"))


@query("""SELECT l_orderkey, l_linenumber, n FROM (
  SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE r = 1""")
def latest_state(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts as an upsert: of all rows of a key the latest stands, with the number it replaces."""
    lines = table(spark, d, "lineitem")
    last = F.max(F.struct("l_shipdate", "l_linenumber"))
    return lines.groupBy("l_orderkey").agg(last["l_linenumber"].alias("l_linenumber"), F.count("*").alias("n"))


@query("SELECT s_suppkey AS slot, s_name || '|' || s_nationkey || '|' || CASE WHEN s_acctbal < 0 THEN 'fast' ELSE 'standard' END AS cache_key FROM supplier")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Composite keys of measurements: host, kind and variant."""
    variant = F.when(F.col("s_acctbal") < 0, "fast").otherwise("standard")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.concat_ws("|", "s_name", "s_nationkey", variant).alias("cache_key"))


@query("""SELECT p_partkey, list_distinct(list_filter([1::BIGINT, p_size // 2, p_size::BIGINT, p_size // 4, p_size * 3 // 4], lambda x: x > 0)).list_sort() AS moves FROM part""")
def batch_moves(spark: SparkSession, d: str) -> DataFrame:
    """How many jobs of a type a move of the search may take: one, a half, all, a quarter, three quarters."""
    return table(spark, d, "part").select("p_partkey", F.array_sort(S.batch_sizes(F.col("p_size"))).alias("moves"))


@query(f"""WITH {PRELUDE} SELECT slot, kind, row_number() OVER (ORDER BY infer_us DESC, slot) AS slow_first, row_number() OVER (ORDER BY infer_us, slot) AS fast_first,
  row_number() OVER (ORDER BY compile_us::DOUBLE / infer_us, slot) AS by_ratio FROM executors""")
def executor_orders(spark: SparkSession, d: str) -> DataFrame:
    """The orders in which executors are filled.  Executors are hardware, a table of bounded size."""
    e = W.executors(spark, d)
    rank = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("bigint")
    ratio = F.col("compile_us").cast("double") / F.col("infer_us")
    return e.select("slot", "kind", rank(F.desc("infer_us"), "slot").alias("slow_first"), rank("infer_us", "slot").alias("fast_first"), rank(ratio, "slot").alias("by_ratio"))


@query(f"""WITH {PRELUDE}, cheapest AS (SELECT shape, min(infer_cost) AS cost FROM costs GROUP BY shape),
work AS (SELECT sum(s.units * c.cost)::BIGINT AS total FROM shapes s JOIN cheapest c USING (shape))
SELECT total, (SELECT count(*) FROM executors) AS n_slots, (total + (SELECT count(*) FROM executors) - 1) // (SELECT count(*) FROM executors) AS bound_us FROM work""")
def work_lower_bound(spark: SparkSession, d: str) -> DataFrame:
    """No plan is faster than all inference at its cheapest rates, spread evenly over all executors."""
    t = W.default(spark)
    units = W.units_by_shape(W.covered(W.jobs(spark, d), t))
    cheapest = W.costs(W.executors(spark, d), units, t).groupBy("shape").agg(F.min("infer_cost").alias("cost"))
    total = units.join(cheapest, "shape").agg(F.sum(F.col("units") * F.col("cost")).alias("total"))
    n = W.executors(spark, d).agg(F.count("*").alias("n_slots"))
    return total.join(F.broadcast(n)).select("total", "n_slots", F.expr("(total + n_slots - 1) div n_slots").alias("bound_us"))


@query(f"""WITH {PRELUDE}, speed AS (SELECT slot, 1e0 / infer_us AS s FROM executors),
dealt AS (SELECT t.shape, t.n, e.slot, floor(t.n * e.s / (SELECT sum(s) FROM speed)) AS whole, t.n * e.s / (SELECT sum(s) FROM speed) AS ideal
  FROM (SELECT shape, count(*) AS n FROM covered GROUP BY shape) t CROSS JOIN speed e)
SELECT shape, count(*) AS n_slots, any_value(n) AS n_jobs, sum(whole)::BIGINT <= any_value(n) AS fits, max(ideal - whole) < 1 AS fair FROM dealt GROUP BY shape""")
def proportional_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each class dealt to executors by speed: whole shares never exceed the class, and miss the ideal by less than one."""
    t = W.default(spark)
    classes = W.covered(W.jobs(spark, d), t).groupBy("shape").agg(F.count("*").alias("n"))
    speed = W.executors(spark, d).select("slot", (F.lit(1.0) / F.col("infer_us")).alias("s"))
    total = speed.agg(F.sum("s").alias("all"))
    # classes of a bounded ladder times executors: small however many jobs there are
    ideal = F.col("n") * F.col("s") / F.col("all")
    dealt = classes.join(F.broadcast(speed.join(F.broadcast(total)))).select("shape", "n", ideal.alias("ideal"), F.floor(ideal).alias("whole"))
    return dealt.groupBy("shape").agg(F.count("*").alias("n_slots"), F.first("n").alias("n_jobs"), (F.sum("whole") <= F.first("n")).alias("fits"), (F.max(F.col("ideal") - F.col("whole")) < 1).alias("fair"))


@query(f"""SELECT doc_id, bucket, CASE WHEN bucket > 2048 THEN n_chars ELSE 8 END::BIGINT AS window_size
FROM (SELECT doc_id, n_chars, coalesce(list_min(list_filter({_LADDER_SQL}, lambda b: b >= n_chars)), n_chars)::BIGINT AS bucket FROM documents)""")
def window_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The look-ahead of a shape: a fixed number of jobs, above 2048 the job's own size."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", S.bucket_for(F.col("n_chars"), ladder()).alias("bucket"))
    return docs.select("doc_id", "bucket", F.when(F.col("bucket") > 2048, F.col("n_chars")).otherwise(8).cast("bigint").alias("window_size"))


@query("""SELECT conv_id, count(*) AS n, count(*) FILTER (late) AS dropped FROM (
  SELECT conv_id, turn < max(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - 4 AS late FROM conversations) GROUP BY conv_id""")
def evicted(spark: SparkSession, d: str) -> DataFrame:
    """Items more than a margin behind their group's newest are dropped from the look-ahead state."""
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    newest = turns.groupBy("conv_id").agg(F.max("turn").alias("newest"))
    return turns.join(newest, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("turn") < F.col("newest") - 4).alias("dropped"))
