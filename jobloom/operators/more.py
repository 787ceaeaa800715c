"""Small operators of planning and running: usable executors, cost tuples, aliases, range sums, run counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions.timing import SQL as PRELUDE
from jobloom.operators import work as W
from jobloom.operators.running import running_total
from jobloom.registry import query, table

#: The cost of an executor that was never measured, inference and compilation.
UNPROBED_US = (1_000_000, 1_000_000)
#: Other names of things, and what they stand for.
ALIASES = {"BUILDING": "construction", "MACHINERY": "machines", "HOUSEHOLD": "home"}


def usable(infer_us: Column, compile_us: Column) -> Column:
    """Whether an executor can be planned: its inference takes time, and its compilation no negative time."""
    return F.coalesce((infer_us > 0) & (compile_us >= 0), F.lit(False))


@query("SELECT s_suppkey AS slot, floor(s_acctbal)::BIGINT AS infer_us, s_nationkey::BIGINT - 3 AS compile_us FROM supplier WHERE floor(s_acctbal) > 0 AND s_nationkey >= 3")
def usable_executors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.floor("s_acctbal").cast("bigint").alias("infer_us"), (F.col("s_nationkey").cast("bigint") - 3).alias("compile_us"))
    return e.filter(usable(F.col("infer_us"), F.col("compile_us")))


@query("""SELECT s_suppkey AS slot, CASE WHEN p THEN floor(s_acctbal)::BIGINT ELSE 1000000 END AS infer_us, CASE WHEN p THEN s_nationkey::BIGINT ELSE 1000000 END AS compile_us, p AS probed
FROM (SELECT *, s_acctbal > 0 AND s_suppkey % 4 <> 0 AS p FROM supplier)""")
def probed_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost tuples of executors; those without a measurement get the fixed one."""
    s = table(spark, d, "supplier").withColumn("probed", (F.col("s_acctbal") > 0) & (F.col("s_suppkey") % 4 != 0))
    infer, comp = F.floor("s_acctbal").cast("bigint"), F.col("s_nationkey").cast("bigint")
    return s.select(F.col("s_suppkey").alias("slot"), F.when(F.col("probed"), infer).otherwise(UNPROBED_US[0]).alias("infer_us"), F.when(F.col("probed"), comp).otherwise(UNPROBED_US[1]).alias("compile_us"), "probed")


@query("SELECT source, count(*) AS n_jobs, count(*) FILTER (doc_id % 3 = 2) AS n_inexact FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 3 = 2) > 0")
def inexact_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose size is an estimate, by source."""
    jobs = table(spark, d, "documents").select("source", (F.col("doc_id") % 3 != 2).alias("exact"))
    return jobs.groupBy("source").agg(F.count("*").alias("n_jobs"), F.count_if(~F.col("exact")).alias("n_inexact")).filter("n_inexact > 0")


@query("""SELECT o_custkey AS slot, sum(1 + o_orderkey % 7)::BIGINT AS own_us, count(*) AS n_own FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey""")
def own_group_costs(spark: SparkSession, d: str) -> DataFrame:
    """An executor's cost without the groups that it shares with others."""
    groups = table(spark, d, "orders").select(F.col("o_custkey").alias("slot"), (F.col("o_orderstatus") == "P").alias("shared"), (F.lit(1) + F.col("o_orderkey") % 7).alias("us"))
    return groups.filter(~F.col("shared")).groupBy("slot").agg(F.sum("us").cast("bigint").alias("own_us"), F.count("*").alias("n_own"))


@query("""SELECT event_id, CASE WHEN user_id % 64 <> 0 THEN 'size ' || (user_id % 64 + 64) || ' is not 64' END AS error FROM events""")
def padded_size_checks(spark: SparkSession, d: str) -> DataFrame:
    """A batch whose padded size is not its shape fails its job, with the reason."""
    size, shape = F.col("user_id") % 64 + 64, F.lit(64)
    return table(spark, d, "events").select("event_id", F.when(size != shape, F.concat(F.lit("size "), size, F.lit(" is not "), shape)).alias("error"))


@query("SELECT c_custkey AS slot, c_nationkey::BIGINT AS kind FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def busy_executors(spark: SparkSession, d: str) -> DataFrame:
    """Executors that have a group to run; the others are not started."""
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(F.col("c_custkey").alias("slot"), F.col("c_nationkey").cast("bigint").alias("kind"))


@query("""SELECT l_orderkey, list_sort(list_distinct(flatten(list(ids)))) AS ids FROM (
  SELECT l_orderkey, [l_returnflag, l_linestatus || l_linenumber] AS ids FROM lineitem) GROUP BY l_orderkey""")
def used_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids that a document's entities use: one each, or a list of copies."""
    rows = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array("l_returnflag", F.concat("l_linestatus", "l_linenumber"))).alias("id"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("id")).alias("ids"))


@query("""SELECT o_orderkey, a IS NOT DISTINCT FROM b AS same FROM (
  SELECT o_orderkey, {'s': o_orderstatus, 'n': [o_custkey, NULL]} AS a, {'s': CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END, 'n': [o_custkey, NULL]} AS b FROM orders)""")
def equal_batches(spark: SparkSession, d: str) -> DataFrame:
    """Deep equality of nested values, nulls being equal."""
    nested = lambda status: F.struct(status.alias("s"), F.array(F.col("o_custkey"), F.lit(None).cast("bigint")).alias("n"))
    a, b = nested(F.col("o_orderstatus")), nested(F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", a.eqNullSafe(b).alias("same"))


def canonical(name: Column, aliases: dict[str, str]) -> Column:
    """What a name stands for: its alias, or itself."""
    pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, name), name)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'machines' WHEN 'HOUSEHOLD' THEN 'home' ELSE c_mktsegment END AS name FROM customer")
def canonical_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", canonical(F.col("c_mktsegment"), ALIASES).alias("name"))


@query("""SELECT event_id, user_id AS job, coalesce(nullif(event_id % 5, 0), c_nationkey) AS tokens FROM events LEFT JOIN customer ON c_custkey = user_id""")
def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Events with their job's size where they do not state it; events of unknown jobs stay.

    The jobs are a static table: the same join holds for a stream of events.
    """
    events = table(spark, d, "events").select("event_id", F.col("user_id").alias("job"), F.nullif(F.col("event_id") % 5, F.lit(0)).alias("stated"))
    jobs = table(spark, d, "customer").select(F.col("c_custkey").alias("job"), F.col("c_nationkey").alias("known"))
    return events.join(jobs, "job", "left").select("event_id", "job", F.coalesce("stated", "known").alias("tokens"))


@query("""WITH plan AS (SELECT l_partkey, l_linenumber, row_number() OVER (ORDER BY l_partkey, l_linenumber, l_orderkey) - 1 AS i, l_orderkey FROM lineitem)
SELECT o_orderkey, i AS place FROM orders JOIN plan ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def plan_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of a job's run in a long plan, looked up by its key; places are counted over many tasks."""
    from jobloom.operators.running import row_numbers

    plan = row_numbers(table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey"), [], ["l_partkey", "l_linenumber", "l_orderkey"], "n")
    first = plan.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("n") - 1).alias("place"))
    return table(spark, d, "orders").select("o_orderkey").join(first, "o_orderkey")


@query("""SELECT o_custkey AS slot, count(DISTINCT o_orderpriority) AS compiles, count(*) FILTER (o_orderstatus = 'F') AS jobs_ok, count(*) FILTER (o_orderstatus = 'P') AS jobs_fail, max(o_orderkey % 9) AS max_live FROM orders GROUP BY o_custkey""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a run counts: shapes compiled, jobs done and failed, the most items alive at once."""
    status = F.col("o_orderstatus")
    shapes = F.size(F.collect_set("o_orderpriority")).cast("bigint")  # a few shapes an executor
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("slot")).agg(shapes.alias("compiles"), F.count_if(status == "F").alias("jobs_ok"), F.count_if(status == "P").alias("jobs_fail"), F.max(F.col("o_orderkey") % 9).alias("max_live"))


@query("""WITH lines AS (SELECT l_orderkey, l_linenumber, sum(l_quantity::BIGINT) AS q FROM lineitem GROUP BY ALL),
sums AS (SELECT l_orderkey, l_linenumber, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::BIGINT AS upto FROM lines)
SELECT l.l_orderkey, (h.upto - coalesce(p.upto, 0))::BIGINT AS units FROM (SELECT DISTINCT l_orderkey FROM lineitem) l
JOIN sums h ON h.l_orderkey = l.l_orderkey AND h.l_linenumber = 3 LEFT JOIN sums p ON p.l_orderkey = l.l_orderkey AND p.l_linenumber = 1""")
def range_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of a range of jobs, as the difference of two prefix sums: lines 2 and 3 of each order."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    sums = running_total(lines, ["l_orderkey"], ["l_linenumber"], "q", "upto")
    at = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("upto")))
    return sums.groupBy("l_orderkey").agg(at(3).alias("high"), at(1).alias("low")).filter("high is not null").select("l_orderkey", (F.col("high") - F.coalesce("low", F.lit(0))).alias("units"))


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS n FROM part)
SELECT p_partkey, n, (SELECT greatest(count(*) - 10, 0) FROM part) AS more FROM r WHERE n <= 10""")
def rejects_report(spark: SparkSession, d: str) -> DataFrame:
    """The first ten rejects, as the feature is, and how many more there are."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    first = part.orderBy("p_size", "p_partkey").limit(10)
    numbered = first.withColumn("n", F.row_number().over(Window.orderBy("p_size", "p_partkey")).cast("bigint"))
    more = part.agg(F.greatest(F.count("*") - 10, F.lit(0)).alias("more"))
    return numbered.join(F.broadcast(more)).select("p_partkey", "n", "more")  # one row


@query(f"""WITH {PRELUDE}, ends AS (SELECT min(compile_us::DOUBLE / infer_us) AS rho, sum(1e0 / infer_us) AS inv FROM executors)
SELECT round(rho, 6) AS least_ratio, round(inv * 1e6, 6) AS speed FROM ends""")
def fluid_terms(spark: SparkSession, d: str) -> DataFrame:
    """What the fluid bound needs of the executors: the least ratio of compilation to inference, and their total speed."""
    e = W.executors(spark, d)
    return e.agg(F.round(F.min(F.col("compile_us").cast("double") / F.col("infer_us")), 6).alias("least_ratio"), F.round(F.sum(F.lit(1.0) / F.col("infer_us")) * 1e6, 6).alias("speed"))
