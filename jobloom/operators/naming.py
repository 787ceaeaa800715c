"""Unique names: repeated ones get the next suffix that no other name has, in the order of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.operators.running import row_numbers, running_total
from jobloom.registry import query, table
from jobloom.storage import discard, materialize

#: What a suffix looks like: a name, and a whole number from 2 on.
SUFFIX = r"(?s)^(.*)_([2-9]|[1-9][0-9]{1,17})$"


def unique_names(rows: DataFrame, base: str, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: the row's base, or the first of ``base_2``, ``base_3``, ... that no row before it has.

    ``order`` should tell rows apart.  Names of one base (a series) count up,
    and meet another base only where that is the series' name with a suffix: a
    base ``x_2`` beside two rows ``x``.  Who comes first has the name; either the
    series skips it, or the base's own rows begin at ``x_2_2``.  Series are
    settled from those whose base is no such name on, a turn a link of such
    chains; in a turn, each number that two could have is compared until no
    answer changes.  Tables without such names take no turn.  A null base is no
    name: it stays null.
    """
    timed = row_numbers(row_numbers(rows, [], order, "_t"), [base], ["_t"], "_n")
    timed = materialize(timed, "named-rows")
    bases = materialize(timed.groupBy(F.col(base).alias("_b")).agg(F.count("*").alias("_count"), F.min("_t").alias("_t0")), "bases")
    children = bases.select(F.regexp_extract("_b", SUFFIX, 1).alias("_p"), F.regexp_extract("_b", SUFFIX, 2).try_cast("bigint").alias("_k"), F.col("_b").alias("_child"), F.col("_t0").alias("_taken_at")).filter("_k is not null")
    links = materialize(children.join(bases.select(F.col("_b").alias("_p")), "_p"), "links")
    moved = _settle(timed.select(F.col(base).alias("_b"), "_t", "_n"), bases, links) if not links.isEmpty() else None
    plain = F.when((F.col("_n") == 1) | F.col(base).isNull(), F.col(base)).otherwise(F.concat_ws("_", base, "_n"))
    kept = [F.col(c) for c in rows.columns]
    if moved is None:
        return timed.select(*kept, plain.alias(out))
    both = timed.join(moved.select("_t", "_number"), "_t", "left")
    name = F.when(F.col("_number") == 1, F.col(base)).otherwise(F.concat_ws("_", base, "_number"))
    return both.select(*kept, F.when(F.col("_number").isNull(), plain).otherwise(name).alias(out))


def _settle(rows: DataFrame, bases: DataFrame, links: DataFrame) -> DataFrame:
    """(_t, _number) of the rows whose series meets another base: 1 is the base itself."""
    spark = rows.sparkSession
    parents = links.select("_p").distinct()
    # series to settle now: the base, and how many of its rows lose the base's own name (none or the first)
    now = materialize(parents.join(links.select(F.col("_child").alias("_p")), "_p", "left_anti").withColumn("_lost", F.lit(0).cast("bigint")), "series")
    parts: list[DataFrame] = []
    while not now.isEmpty():
        answers = _answers(rows, links.join(now, "_p"))
        skipped = answers.filter("_skip = 1").select(F.col("_p").alias("_b"), F.col("_r"), F.lit(0).alias("_is_row"), F.lit(None).cast("bigint").alias("_t"), F.lit(1).cast("bigint").alias("_step"))
        own = rows.join(now.withColumnRenamed("_p", "_b"), "_b").select("_b", (F.col("_n") - 1 + F.col("_lost")).alias("_r"), F.lit(1).alias("_is_row"), "_t", F.lit(0).cast("bigint").alias("_step"))
        counted = running_total(own.unionByName(skipped), ["_b"], ["_r", "_is_row", "_t"], "_step", "_moved").filter("_is_row = 1")
        parts.append(materialize(counted.select("_t", F.when(F.col("_r") == 0, F.lit(1).cast("bigint")).otherwise(F.col("_r") + 1 + F.col("_moved")).alias("_number")), "numbers"))
        after = answers.select(F.col("_child").alias("_p"), F.when(F.col("_at").isNotNull() & (F.col("_skip") == 0), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("_lost"))
        # a base that lost its name counts from 2 on even if no other base meets its series
        nxt = materialize(after.filter("_lost = 1").unionByName(after.filter("_lost = 0").join(parents, "_p", "left_semi")), "series")
        discard(now, answers)
        now = nxt
    out = parts[0] if parts else spark.createDataFrame([], "_t bigint, _number bigint")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _answers(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` (_p, _k, _child, _taken_at, _lost) with the row that reaches number k (_r; _at: its time) and whether it must skip it.

    Numbers that are skipped before k make the series reach k sooner, so an
    answer depends on those before it: each pass settles at least one more, and
    most at once.
    """
    lookup = rows.select(F.col("_b").alias("_p"), F.col("_n").alias("_row"), F.col("_t").alias("_at"))
    before = Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    state = materialize(links.withColumn("_skip", F.lit(0).cast("bigint")), "links")
    while True:
        placed = state.withColumn("_r", F.col("_k") - 1 - F.coalesce(F.sum("_skip").over(before), F.lit(0)))
        met = placed.withColumn("_row", F.col("_r") + 1 - F.col("_lost")).join(lookup, ["_p", "_row"], "left").drop("_row")
        skip = F.when(F.col("_at") > F.col("_taken_at"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        new = materialize(met.withColumn("_was", F.col("_skip")).withColumn("_skip", skip), "links")
        discard(state)
        if new.filter("_was <> _skip").isEmpty():
            return new
        state = new.drop("_was", "_at", "_r")
        state.__dict__["_scratch"] = new.__dict__["_scratch"]


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY doc_id) AS i FROM (
  SELECT doc_id, source || '-' || lang AS root, source || '-' || lang || CASE doc_id % 3 WHEN 1 THEN '_' || (2 + doc_id % 7) WHEN 2 THEN CASE WHEN doc_id % 4 = 0 THEN '_2_' || (2 + doc_id % 2) ELSE '' END ELSE '' END AS base FROM documents)),
n AS (SELECT doc_id, root, i, base AS name, [base] AS used FROM r WHERE i = 1
  UNION ALL
  SELECT doc_id, root, i, name, list_append(used, name) FROM (
    SELECT r.doc_id, r.root, r.i, n.used, CASE WHEN NOT list_contains(n.used, r.base) THEN r.base
      ELSE r.base || '_' || list_min(list_filter(range(2, len(n.used) + 3), lambda k: NOT list_contains(n.used, r.base || '_' || k))) END AS name
    FROM n JOIN r ON r.root = n.root AND r.i = n.i + 1))
SELECT doc_id, name FROM n""")
def cascading_names(spark: SparkSession, d: str) -> DataFrame:
    """Unique names where some bases look like names that others would get."""
    root = F.concat_ws("-", "source", "lang")
    more = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("_"), 2 + F.col("doc_id") % 7)).when((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 4 == 0), F.concat(F.lit("_2_"), 2 + F.col("doc_id") % 2)).otherwise("")
    docs = table(spark, d, "documents").select("doc_id", F.concat(root, more).alias("base"))
    return unique_names(docs, "base", ["doc_id"], "name").select("doc_id", "name")
