"""Mixing sources to target weights by weighted fair queueing.

Each document of a shuffled source gets a virtual finish time: the tokens of
its source up to and including it, divided by the source's target.  All
documents are then sorted by that time over the whole cluster and taken until
the total budget is used.  A source whose target exceeds its size is queued up
to three times, epoch after epoch.

Running totals are computed in two levels (within the partitions of a range
sort, then over one row a partition), so a source with any share of the rows
is spread over many tasks.

Defined results: a null or text without words has size 0, takes 0 words and is
never repeated; the null source comes last; ties of the shuffle key are
ordered by id and then by row; repeated rows are separate documents; very long
texts count whole; an empty table mixes to an empty table; extra columns are
not read and, where documents are mixed, come back as they are, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.running import running_total
from jobloom.storage import materialize

EPOCHS = 3
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, source_rank, target) from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  With caps of
    three times a source's size, resharing the excess by weight until no
    target is above its cap ends at one water level: sources are filled in the
    order of cap / weight, and the first one whose cap lies above the level of
    the rest sets the level for all that are not capped.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    ranked = sums.withColumn("source_rank", rank)
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("source_rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")
    caps = ranked.withColumn("w", w).withColumn("cap", (F.lit(EPOCHS) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    ahead, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    filled = caps.withColumn("level", level).withColumn("at", F.row_number().over(fill))
    open_ = F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct("at", "level"))
    final = F.min(open_).over(every)["level"]
    return filled.select("source", "source_size", "source_rank", F.coalesce(F.least("cap", final * F.col("w")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, salt: str = "mix") -> DataFrame:
    """One row a document: row, id, size, source_size, target of its source, words and copies taken.

    ``row_col`` names a stable row number; without one, rows are numbered as
    they are written.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    key = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = materialize(docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("key")), "sized")
    plan = materialize(targets(sized), "targets")
    queued = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select("row", "id", "key", "size", "source_rank", "source_size", "target")
    lined = running_total(queued, ["source_rank"], ["key", "id", "row"], "size", "upto")
    # only a copy that starts before its source's target is reached can be taken
    copies = lined.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))).alias("epoch"))
    begun = F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size")
    units = copies.filter(begun < F.col("target")).select("row", "source_rank", "epoch", "size", ((begun + F.col("size")) / F.col("target")).alias("finish"))
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    sorted_ = running_total(units, [], ["finish", "source_rank", "epoch", "row"], "size", "used")
    kept = sorted_.join(F.broadcast(budget), F.col("used") <= F.col("budget"))  # the budget is one row
    got = kept.groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    return (
        queued.join(got, "row", "left")
        .select("row", F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as it takes it."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    columns = {"id": id_col, "text": text_col, "source": source_col}
    plain = numbered.select("row", *(F.col("doc").getField(c).alias(n) for n, c in columns.items()))
    taken = mix(plain, "id", "text", "source", "row").filter("copies > 0").select("row", "copies")
    often = numbered.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return often.select("doc.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sums),
caps AS (SELECT *, ((source_rank - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM ranked),
filled AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source_rank) AS pos,
    ((sum(source_size) OVER ())::BIGINT::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps),
final AS (SELECT level FROM filled WHERE cap / w > level ORDER BY pos LIMIT 1),
plan AS (
  SELECT source, source_size, source_rank,
         coalesce(least(cap, (SELECT level FROM final) * w), cap) AS target
  FROM filled),
lined AS (
  SELECT d.doc_id, d.size, d.key, p.source_size, p.source_rank, p.target,
    (sum(d.size) OVER (PARTITION BY p.source_rank ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
units AS (
  SELECT doc_id, source_rank, size, key, e.epoch, (e.epoch * source_size + upto) / target AS finish
  FROM lined, (VALUES (0::BIGINT), (1), (2)) e(epoch)
  WHERE size > 0 AND e.epoch * source_size + upto - size < target),
used AS (
  SELECT doc_id, size,
    sum(size) OVER (ORDER BY finish, source_rank, epoch, key, doc_id ROWS UNBOUNDED PRECEDING) AS used
  FROM units),
got AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM used
  WHERE used <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM lined l LEFT JOIN got g ON l.doc_id IS NOT DISTINCT FROM g.doc_id
"""
