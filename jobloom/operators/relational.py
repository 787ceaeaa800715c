"""Joins, aggregates, windows, sorts and set operations of the planning pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions import scalars as S
from jobloom.functions.timing import SQL as PRELUDE
from jobloom.operators import work as W
from jobloom.operators.expressions import _LADDER_SQL, ladder
from jobloom.operators.running import row_numbers, running_total
from jobloom.registry import query, table

#: Rows of two numbers that a task sorts or hashes at once, some 100 MB.
TASK_ROWS = 1_000_000


def partitions(spark: SparkSession, rows: int) -> int:
    """How many partitions keep a task's share of the rows the same, however many there are; at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


# ---------------------------------------------------------------- joins


@query("SELECT d.doc_id, t.bucket FROM (SELECT doc_id, n_chars FROM documents) d ASOF LEFT JOIN (SELECT unnest(range(64, 5121, 64))::BIGINT AS bucket) t ON d.n_chars <= t.bucket")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """As-of join to the next bucket: a lookup in a literal array, so no shuffle and no range join."""
    t = W.default(spark)
    return table(spark, d, "documents").select("doc_id", S.snap_up(F.col("n_chars"), t.buckets).alias("bucket"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.quality = 1 THEN 'done' WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'failed' END AS skip FROM documents d LEFT JOIN labels l USING (doc_id)")
def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    """State of earlier runs joined to jobs: done before failed, null is to run."""
    state = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    jobs = table(spark, d, "documents").select("doc_id")
    return jobs.join(state, "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "done").when(F.col("toxic") == 1, "failed").alias("skip"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH own AS (SELECT s_suppkey AS slot, s_nationkey AS kind, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS own FROM supplier),
sample AS (SELECT kind, arg_min(own, slot) FILTER (own IS NOT NULL) AS shared FROM own GROUP BY kind)
SELECT slot, kind, coalesce(own, shared, 1e0) AS s_ms, CASE WHEN own IS NOT NULL THEN 'own' WHEN shared IS NOT NULL THEN 'kind' ELSE 'unit' END AS origin FROM own JOIN sample USING (kind)""")
def executor_fallback(spark: SparkSession, d: str) -> DataFrame:
    """An executor's own measurement, else its kind's first, else a unit."""
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_nationkey").alias("kind"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("own"))
    sample = own.filter("own is not null").groupBy("kind").agg(F.min(F.struct("slot", "own"))["own"].alias("shared"))
    rows = own.join(sample, "kind", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("shared").isNotNull(), "kind").otherwise("unit")
    return rows.select("slot", "kind", F.coalesce("own", "shared", F.lit(1.0)).alias("s_ms"), origin.alias("origin"))


@query(f"WITH {PRELUDE} SELECT DISTINCT bucket FROM timing WHERE bucket IN (SELECT unnest({_LADDER_SQL}))")
def semi_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Ladder rungs that the timing table has."""
    from jobloom.functions.timing import default_timing

    rungs = spark.range(1).select(F.explode(ladder()).alias("bucket"))
    return default_timing(spark).select("bucket").join(rungs, "bucket", "left_semi")


@query(f"""WITH {PRELUDE}, floor AS (SELECT c.job_id, min(k.compile_cost + c.n_seeds * k.infer_cost) AS cost FROM covered c JOIN costs k USING (shape) GROUP BY c.job_id)
SELECT cost AS floor_us, job_id FROM floor ORDER BY cost DESC, job_id LIMIT 1""")
def floor_job(spark: SparkSession, d: str) -> DataFrame:
    """The job whose best executor takes longest: min over executors, then max over jobs, first wins.

    Executors' costs meet (shape, seeds) types, not jobs.
    """
    t = W.default(spark)
    c = W.covered(W.jobs(spark, d), t)
    types = c.groupBy("shape", "n_seeds").agg(F.min("job_id").alias("job_id"))
    cheapest = types.join(W.costs(W.executors(spark, d), types, t), "shape").groupBy("shape", "n_seeds", "job_id").agg(F.min(F.col("compile_cost") + F.col("n_seeds") * F.col("infer_cost")).alias("cost"))
    top = cheapest.agg(F.max(F.struct("cost", (-F.col("job_id")).alias("neg"))).alias("m"))
    return top.select(F.col("m.cost").alias("floor_us"), (-F.col("m.neg")).alias("job_id"))


@query("""SELECT c.c_custkey, n.n_name, count(o.o_orderkey) AS n_orders FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, n.n_name""")
def attribute_join(spark: SparkSession, d: str) -> DataFrame:
    """Inner join to attributes (missing ones drop out), left join to counts made before the join."""
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    c = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(counts, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT e.event_id, coalesce(c.n, 1) AS n_seeds FROM events e LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON e.user_id = c.conv_id")
def seeds_or_one(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("user_id")).agg(F.count("*").alias("n"))
    return table(spark, d, "events").select("event_id", "user_id").join(n, "user_id", "left").select("event_id", F.coalesce("n", F.lit(1)).alias("n_seeds"))


@query("""SELECT r.ord, s.s_suppkey AS slot FROM (SELECT n_nationkey AS ord, n_nationkey::VARCHAR AS want FROM nation) r
JOIN supplier s ON r.want = s.s_suppkey::VARCHAR OR r.want = 'n' || s.s_nationkey::VARCHAR""")
def executor_selection(spark: SparkSession, d: str) -> DataFrame:
    """Requests by index or by name: the two keys are exploded, so the OR becomes an equi join."""
    wanted = table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("want"))
    keys = F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    named = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.explode(F.array_distinct(keys)).alias("want"))
    return wanted.join(named, "want").select("ord", "slot").distinct()


@query(f"""WITH {PRELUDE}, dom AS (SELECT s.shape FROM costs s WHERE s.kind = (SELECT min(kind) FROM kinds))
SELECT a.kind, a.shape FROM costs a WHERE NOT EXISTS (SELECT 1 FROM costs b WHERE b.kind = a.kind AND b.shape > a.shape AND b.compile_cost <= a.compile_cost AND b.infer_cost <= a.infer_cost)""")
def skyline_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that no larger shape dominates in both costs: an anti join on a bounded table."""
    t = W.default(spark)
    c = W.costs(W.executors(spark, d), W.covered(W.jobs(spark, d), t), t)
    a, b = c.alias("a"), c.alias("b")
    worse = (F.col("a.kind") == F.col("b.kind")) & (F.col("b.shape") > F.col("a.shape")) & (F.col("b.compile_cost") <= F.col("a.compile_cost")) & (F.col("b.infer_cost") <= F.col("a.infer_cost"))
    return a.join(b, worse, "left_anti").select("kind", "shape")


@query("SELECT l.l_orderkey, l.l_linenumber, min(g.ord) AS ord FROM lineitem l JOIN (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders) g ON g.o_orderkey = l.l_orderkey GROUP BY 1, 2")
def group_of_job(spark: SparkSession, d: str) -> DataFrame:
    """The ordinal of the first group that holds a job."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    # a task's tables are as large as its partition: the number of partitions grows with the rows, which the files' footers tell
    parts = partitions(spark, lines.count())
    ord_ = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint")
    groups = orders.select("o_custkey", "o_orderkey").repartition(parts, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), ord_.alias("ord"))
    first = groups.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.min("ord").alias("ord"))
    return lines.repartition(parts, "l_orderkey").distinct().join(first, "l_orderkey")


# ---------------------------------------------------------------- aggregates


@query(f"WITH {PRELUDE} SELECT shape, units, n_jobs FROM shapes")
def units_by_class(spark: SparkSession, d: str) -> DataFrame:
    return W.units_by_shape(W.covered(W.jobs(spark, d), W.default(spark)))


@query(f"WITH {PRELUDE} SELECT shape, n_seeds, count(*) AS n_jobs, min(job_id) AS first_job FROM covered GROUP BY shape, n_seeds")
def job_types(spark: SparkSession, d: str) -> DataFrame:
    return W.covered(W.jobs(spark, d), W.default(spark)).groupBy("shape", "n_seeds").agg(F.count("*").alias("n_jobs"), F.min("job_id").alias("first_job"))


@query(f"WITH {PRELUDE} SELECT shape, (sum(units) OVER (ORDER BY shape))::BIGINT AS upto FROM shapes")
def cumulative_units(spark: SparkSession, d: str) -> DataFrame:
    """Running units over the distinct shapes, of which there are few."""
    u = W.units_by_shape(W.covered(W.jobs(spark, d), W.default(spark)))
    return u.select("shape", F.sum("units").over(Window.orderBy("shape")).alias("upto"))


_ASSIGNED = f"""{PRELUDE}, numbered AS (SELECT *, row_number() OVER (ORDER BY slot) - 1 AS ord, count(*) OVER () AS n_slots FROM executors),
assigned AS (SELECT c.*, n.slot, n.kind FROM covered c JOIN numbered n ON c.job_id % n.n_slots = n.ord),
loads AS (SELECT slot, sum(compile_cost + units * infer_cost)::BIGINT AS load FROM (
  SELECT slot, kind, shape, sum(n_seeds)::BIGINT AS units FROM assigned GROUP BY 1, 2, 3) JOIN costs USING (kind, shape) GROUP BY slot)"""


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """Jobs dealt to executors by job number: (job_id, tokens, n_seeds, shape, slot, kind)."""
    e = W.executors(spark, d)
    # executors are hardware: a table of bounded size, numbered in one task
    numbered = e.select("slot", "kind", (F.row_number().over(Window.orderBy("slot")) - 1).cast("bigint").alias("ord"))
    n = e.agg(F.count("*").alias("n_slots"))
    jobs = W.covered(W.jobs(spark, d), W.default(spark)).join(F.broadcast(n)).withColumn("ord", F.col("job_id") % F.col("n_slots")).drop("n_slots")
    return jobs.join(numbered, "ord").drop("ord")


def slot_loads(spark: SparkSession, d: str) -> DataFrame:
    t = W.default(spark)
    a = assigned(spark, d).groupBy("slot", "kind", "shape").agg(F.sum("n_seeds").alias("units"))
    return a.join(W.costs(W.executors(spark, d), a, t), ["kind", "shape"]).groupBy("slot").agg(F.sum(F.col("compile_cost") + F.col("units") * F.col("infer_cost")).alias("load"))


@query(f"WITH {_ASSIGNED} SELECT slot, load FROM loads")
def group_costs(spark: SparkSession, d: str) -> DataFrame:
    return slot_loads(spark, d)


@query(f"WITH {_ASSIGNED} SELECT max(load) AS makespan, count(*) AS n_slots FROM loads")
def makespan(spark: SparkSession, d: str) -> DataFrame:
    return slot_loads(spark, d).agg(F.max("load").alias("makespan"), F.count("*").alias("n_slots"))


@query(f"WITH {PRELUDE} SELECT shape, max(n_seeds) AS n_seeds, arg_min(job_id, (-n_seeds, job_id)) AS job_id FROM covered GROUP BY shape")
def hardest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The job of most seeds in each class; the first wins a tie."""
    m = F.max(F.struct("n_seeds", (-F.col("job_id")).alias("neg")))
    return W.covered(W.jobs(spark, d), W.default(spark)).groupBy("shape").agg(m.alias("m")).select("shape", "m.n_seeds", (-F.col("m.neg")).alias("job_id"))


@query("SELECT l_orderkey, arg_min(l_linenumber, (-l_extendedprice, l_linenumber)) AS best_line, max(l_extendedprice) AS score FROM lineitem GROUP BY l_orderkey")
def best_per_job(spark: SparkSession, d: str) -> DataFrame:
    m = F.max(F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("neg")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(m.alias("m")).select("l_orderkey", (-F.col("m.neg")).alias("best_line"), F.col("m.l_extendedprice").alias("score"))


@query(f"WITH {_ASSIGNED} SELECT shape, count(DISTINCT slot) AS n_slots FROM assigned GROUP BY shape HAVING count(DISTINCT slot) > 1")
def shared_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes that more than one executor compiles."""
    pairs = assigned(spark, d).select("shape", "slot").distinct()
    return pairs.groupBy("shape").agg(F.count("*").alias("n_slots")).filter("n_slots > 1")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) AS n, sum(value) FILTER (event_type = 'purchase') IS NOT NULL AS bought FROM events GROUP BY user_id")
def event_counts(spark: SparkSession, d: str) -> DataFrame:
    bought = F.count_if((F.col("event_type") == "purchase") & F.col("value").isNotNull()) > 0
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("n"), bought.alias("bought"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def done_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"))


@query(f"""WITH {_ASSIGNED} SELECT slot, shape, count(*) AS n_jobs, sum(n_seeds)::BIGINT AS n_inf,
  round_even(sum(n_seeds * infer_cost)::DOUBLE / count(*), 0)::BIGINT AS mean_us, (sum(n_seeds * infer_cost) + min(compile_cost))::BIGINT AS total_us
FROM assigned JOIN costs USING (kind, shape) GROUP BY slot, shape""")
def bucket_report(spark: SparkSession, d: str) -> DataFrame:
    t = W.default(spark)
    g = assigned(spark, d).groupBy("slot", "kind", "shape").agg(F.count("*").alias("n_jobs"), F.sum("n_seeds").alias("n_inf"))
    spent = F.col("n_inf") * F.col("infer_cost")
    return g.join(W.costs(W.executors(spark, d), g, t), ["kind", "shape"]).select("slot", "shape", "n_jobs", "n_inf", F.rint(spent.cast("double") / F.col("n_jobs")).cast("bigint").alias("mean_us"), (spent + F.col("compile_cost")).alias("total_us"))


@query("SELECT l_orderkey, count(*) = max(l_linenumber) AS complete, sum(l_quantity) AS infer_ms FROM lineitem GROUP BY l_orderkey")
def job_completion(spark: SparkSession, d: str) -> DataFrame:
    """A job is done once all of its seeds are; total time of its parts."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.count("*") == F.max("l_linenumber")).alias("complete"), F.sum("l_quantity").alias("infer_ms"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS sum_qty, avg(l_quantity) AS avg_qty, max(l_discount) AS max_disc FROM lineitem GROUP BY 1, 2")
def pool_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("sum_qty"), F.avg("l_quantity").alias("avg_qty"), F.max("l_discount").alias("max_disc"))


@query("SELECT kind, min(slot) AS slot, count(*) AS n FROM (SELECT s_suppkey AS slot, s_nationkey AS kind FROM supplier) GROUP BY kind")
def one_per_kind(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("kind")).agg(F.min("s_suppkey").alias("slot"), F.count("*").alias("n"))


@query("SELECT slot, dense_rank() OVER (ORDER BY first) - 1 AS kind_index FROM (SELECT s_suppkey AS slot, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)")
def kind_index(spark: SparkSession, d: str) -> DataFrame:
    """Kinds numbered by first appearance: ranked among kinds, then joined back."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_nationkey").alias("kind"))
    ranked = s.groupBy("kind").agg(F.min("slot").alias("first")).select("kind", (F.row_number().over(Window.orderBy("first")) - 1).cast("bigint").alias("kind_index"))
    return s.join(ranked, "kind").select("slot", "kind_index")


@query("SELECT max(n) + 4 + 3 AS margin FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def lookahead_margin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").count().agg((F.max("count") + 4 + 3).alias("margin"))


# ---------------------------------------------------------------- windows


@query("""SELECT doc_id, n > 1 AS duplicate FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(left(text, 40)) ORDER BY doc_id) AS n FROM documents)""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive duplicates of a name; the first wins.

    A grouped minimum finds the first, so no window has to sort a hot group.
    """
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.left("text", F.lit(40))).alias("name"))
    first = docs.groupBy("name").agg(F.min("doc_id").alias("first"))
    return docs.join(first, docs["name"].eqNullSafe(first["name"])).select("doc_id", (F.col("doc_id") > F.col("first")).alias("duplicate"))


@query(f"""WITH {_ASSIGNED} SELECT a.slot, a.job_id, sum(CASE WHEN r = 1 THEN compile_cost ELSE 0 END + n_seeds * infer_cost) OVER (PARTITION BY a.slot ORDER BY a.shape, a.job_id ROWS UNBOUNDED PRECEDING)::BIGINT AS finish
FROM (SELECT *, row_number() OVER (PARTITION BY slot, shape ORDER BY job_id) AS r FROM assigned) a JOIN costs USING (kind, shape)""")
def prefix_finish(spark: SparkSession, d: str) -> DataFrame:
    """Finish time of each job: compile once a group, then its inferences, running over the executor's queue.

    A queue may be long, so its sum runs over many tasks.
    """
    t = W.default(spark)
    a = assigned(spark, d)
    opening = a.groupBy("slot", "shape").agg(F.min("job_id").alias("opening"))
    rows = a.join(W.costs(W.executors(spark, d), a, t), ["kind", "shape"]).join(opening, ["slot", "shape"])
    cost = F.when(F.col("job_id") == F.col("opening"), F.col("compile_cost")).otherwise(0) + F.col("n_seeds") * F.col("infer_cost")
    return running_total(rows.select("slot", "shape", "job_id", cost.alias("cost")), ["slot"], ["shape", "job_id"], "cost", "finish").select("slot", "job_id", "finish")


@query("SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) % 4 AS slot FROM customer")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    dealt = row_numbers(table(spark, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], ["c_custkey"], "n")
    return dealt.select("c_custkey", ((F.col("n") - 1) % 4).alias("slot"))


@query(f"""WITH {_ASSIGNED} SELECT slot AS victim, job_id, row_number() OVER (PARTITION BY slot ORDER BY shape DESC, job_id DESC) AS k FROM assigned""")
def steal_order(spark: SparkSession, d: str) -> DataFrame:
    """Each victim's jobs from the last one; thieves go through all victims by (k, victim)."""
    jobs = assigned(spark, d).select(F.col("slot").alias("victim"), "job_id", (-F.col("shape")).alias("wide"), (-F.col("job_id")).alias("late"))
    return row_numbers(jobs, ["victim"], ["wide", "late"], "k").select("victim", "job_id", "k")


@query("SELECT l_suppkey, l_returnflag, min(l_shipdate) AS first_at, count(*) AS n FROM lineitem GROUP BY 1, 2")
def first_compile(spark: SparkSession, d: str) -> DataFrame:
    """The first time a (slot, shape) pair is seen is its compile event."""
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_shipdate").alias("first_at"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM conversations""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    """Gaps and islands: a segment starts at each turn of a user."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("segment"))


@query("""SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS arrival, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM conversations""")
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("bigint")
    gap = F.col("turn") - F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "role", "turn", rank.alias("arrival"), gap.alias("gap"))


@query("""SELECT source, lang, whole + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY rest DESC, source) <= 1000 - sum(whole) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS share
FROM (SELECT source, lang, n * 1000 // sum(n) OVER (PARTITION BY lang)::BIGINT AS whole, n * 1000 % sum(n) OVER (PARTITION BY lang)::BIGINT AS rest
  FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2))""")
def apportionment(spark: SparkSession, d: str) -> DataFrame:
    """Largest remainders: a thousand shares of each language over its sources."""
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    parts = n.withColumn("all", F.sum("n").over(by)).select("source", "lang", F.expr("n * 1000 div all").alias("whole"), F.expr("n * 1000 % all").alias("rest"))
    left = F.lit(1000) - F.sum("whole").over(by)
    one = F.row_number().over(by.orderBy(F.desc("rest"), "source")) <= left
    return parts.select("source", "lang", (F.col("whole") + F.when(one, 1).otherwise(0)).alias("share"))


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS ahead FROM conversations")
def look_ahead(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 3)
    return table(spark, d, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("ahead"))


@query("""SELECT doc_id, CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END AS name FROM (
  SELECT doc_id, source || '-' || lang AS stem, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Suffixes _2, _3 and so on for repeated stems."""
    numbered = row_numbers(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"], "n")
    stem, n = F.concat_ws("-", "source", "lang"), F.col("n")
    return numbered.select("doc_id", F.when(n == 1, stem).otherwise(F.concat_ws("_", stem, n)).alias("name"))


# ---------------------------------------------------------------- sorts, top-k, sets


@query(f"WITH {PRELUDE} SELECT shape, n_seeds, n, r FROM (SELECT shape, n_seeds, count(*) AS n, row_number() OVER (PARTITION BY n_seeds ORDER BY count(*) DESC, shape) AS r FROM covered GROUP BY 1, 2) WHERE r <= 8")
def topk_types(spark: SparkSession, d: str) -> DataFrame:
    """The eight largest classes for each number of seeds: a top-k report."""
    g = W.covered(W.jobs(spark, d), W.default(spark)).groupBy("shape", "n_seeds").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("n_seeds").orderBy(F.desc("n"), "shape")).cast("bigint")
    return g.withColumn("r", r).filter("r <= 8")


@query("SELECT reason, doc_id FROM (SELECT doc_id, CASE WHEN n_chars > 10000 THEN 'too long' WHEN n_chars < 100 THEN 'too short' END AS reason FROM documents) WHERE reason IS NOT NULL ORDER BY doc_id LIMIT 10")
def first_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The report's ten first rejects."""
    reason = F.when(F.col("n_chars") > 10_000, "too long").when(F.col("n_chars") < 100, "too short")
    return table(spark, d, "documents").select(reason.alias("reason"), "doc_id").filter("reason is not null").orderBy("doc_id").limit(10)


@query("SELECT o_custkey, list_sort(list(o_orderkey), 'DESC')[1:5] AS newest FROM orders GROUP BY o_custkey")
def load_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The five newest orders of each customer: a window limit drops the others before the shuffle."""
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    few = table(spark, d, "orders").select("o_custkey", "o_orderkey", newest.alias("n")).filter("n <= 5")
    return few.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("newest"))


@query(f"WITH {PRELUDE} SELECT shape FROM covered UNION SELECT unnest({_LADDER_SQL})::BIGINT")
def shape_union(spark: SparkSession, d: str) -> DataFrame:
    rungs = spark.range(1).select(F.explode(ladder()).alias("shape"))
    return W.covered(W.jobs(spark, d), W.default(spark)).select("shape").distinct().union(rungs).distinct()


@query(f"WITH {PRELUDE} SELECT shape FROM covered INTERSECT SELECT unnest({_LADDER_SQL})::BIGINT")
def shape_intersection(spark: SparkSession, d: str) -> DataFrame:
    rungs = spark.range(1).select(F.explode(ladder()).alias("shape"))
    return W.covered(W.jobs(spark, d), W.default(spark)).select("shape").intersect(rungs)


@query("SELECT doc_id, 'accepted' AS state FROM documents WHERE n_chars <= 5120 UNION ALL SELECT doc_id, 'rejected' FROM documents WHERE n_chars > 5120")
def accepted_and_rejected(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    ok = docs.filter("n_chars <= 5120").select("doc_id", F.lit("accepted").alias("state"))
    return ok.unionByName(docs.filter("n_chars > 5120").select("doc_id", F.lit("rejected").alias("state")))
