"""Timing tables and integer costs.

A table has a relative inference and compile factor for each bucket, 1.0 at
bucket 1024.  ``default_timing`` makes one by rule; users supply measured ones
as a DataFrame (bucket, inf, comp).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.functions.scalars import ceil_multiple, snap_up

REFERENCE_BUCKET = 1024
ALIGN = 64
TABLE_MAX = 5120
#: Coefficients of the cubic that extends inference factors.
CUBIC = (0.33, 0.42, 0.27)
#: Seconds of the reference measurement.
REFERENCE_SECONDS = 59.423


def shape_factor(bucket: Column) -> Column:
    a, b, c = CUBIC
    u = bucket.cast("double") / float(REFERENCE_BUCKET)
    return F.greatest(F.lit(1.0) + F.lit(a) * (u - 1.0) + F.lit(b) * (u * u - 1.0) + F.lit(c) * (u * u * u - 1.0), F.lit(1e-6))


def default_timing(spark: SparkSession) -> DataFrame:
    """Buckets of 64 to 5120; factors from the cubic with small steps, so neither column is monotone."""
    b = F.col("id")
    inf = shape_factor(b) * (F.lit(1.0) + F.lit(2e-2) * (F.floor(b / 64) % 3))
    comp = F.lit(1.0) + F.lit(5e-2) * (F.floor(b / 64) % 5)
    return spark.range(ALIGN, TABLE_MAX + 1, ALIGN).coalesce(1).select(b.alias("bucket"), inf.alias("inf"), comp.alias("comp"))


#: The columns of a measured table's file.
TIMING_CSV = "Bucket_size bigint, Inference_modifier double, Compilation_modifier double"


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, inf, comp) from a CSV file with a header; columns are found by name, in any order, others are left.

    A row without a whole positive bucket or a positive factor is an error, and
    so is a bucket that is there twice.
    """
    raw = spark.read.csv(path, header=True)
    names = [c.split()[0] for c in TIMING_CSV.split(", ")]
    if missing := [c for c in names if c not in raw.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    b, i, c = F.col(names[0]).try_cast("bigint"), F.col(names[1]).try_cast("double"), F.col(names[2]).try_cast("double")
    fine = F.coalesce((b > 0) & (i > 0) & (c > 0) & (i < float("inf")) & (c < float("inf")), F.lit(False))
    told = F.concat(F.lit(f"{path}: no timing in the row "), F.to_json(F.struct(*names)))
    rows = raw.select(F.when(fine, b).otherwise(F.raise_error(told).cast("bigint")).alias("bucket"), i.alias("inf"), c.alias("comp"))
    twice = F.concat(F.lit(f"{path}: more than one row for bucket "), F.col("bucket"))
    one = rows.groupBy("bucket").agg(F.count("*").alias("_n"), F.first("inf").alias("inf"), F.first("comp").alias("comp"))
    return one.select(F.when(F.col("_n") == 1, F.col("bucket")).otherwise(F.raise_error(twice).cast("bigint")).alias("bucket"), "inf", "comp")


class TimingTables:
    """Timing tables by name: files, or DataFrames (bucket, inf, comp); ``default`` is the one by rule."""

    def __init__(self, spark: SparkSession, tables: dict[str, str | DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})

    def names(self) -> list[str]:
        return sorted({"default", *self.tables})

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            found = self.tables[name]
            return read_timing(self.spark, found) if isinstance(found, str) else found.select("bucket", "inf", "comp")
        if name == "default":
            return default_timing(self.spark)
        raise ValueError(f"no timing table {name!r}; there are {', '.join(self.names())}")


def table_array(timing: DataFrame) -> list[tuple[int, float, float]]:
    """The table's rows in order; a few hundred at most, so they travel as a literal."""
    rows = sorted((r.bucket, r.inf, r.comp) for r in timing.limit(10_001).collect())
    if len(rows) > 10_000:
        raise ValueError("a timing table of over 10,000 buckets")
    return rows


class Timing:
    """Cost expressions over one table, held as literal arrays and maps."""

    def __init__(self, rows: list[tuple[int, float, float]]):
        self.max = rows[-1][0]
        # one expression text each: thousands of literals one by one would take longer to send than to run
        self.buckets = F.expr(f"array({', '.join(f'{b}L' for b, _, _ in rows)})")
        self.inf = F.expr(f"map({', '.join(f'{b}, {float(x)!r}D' for b, x, _ in rows)})")
        self.comp = F.expr(f"map({', '.join(f'{b}, {float(x)!r}D' for b, _, x in rows)})")

    def snap(self, n: Column) -> Column:
        """The next bucket, at most the table's largest."""
        return F.coalesce(snap_up(n, self.buckets), F.lit(self.max).cast("bigint"))

    def cover(self, tokens: Column) -> Column:
        """The smallest shape for a job: the next bucket, above the table a multiple of 64."""
        return F.when(tokens <= self.max, self.snap(tokens)).otherwise(ceil_multiple(tokens, ALIGN))

    def inference_factor(self, shape: Column) -> Column:
        return F.when(shape > self.max, shape_factor(shape)).otherwise(F.try_element_at(self.inf, self.snap(shape).cast("int")))

    def compile_factor(self, shape: Column) -> Column:
        return F.try_element_at(self.comp, self.snap(shape).cast("int"))

    def inference_us(self, base: Column, shape: Column) -> Column:
        """Whole microseconds, rounded half to even, at least 1; 0 without a base."""
        cost = F.greatest(F.lit(1).cast("bigint"), F.rint(base * self.inference_factor(shape)).cast("bigint"))
        return F.when(base <= 0, F.lit(0).cast("bigint")).otherwise(cost)

    def compile_us(self, base: Column, shape: Column) -> Column:
        cost = F.greatest(F.lit(0).cast("bigint"), F.rint(base * self.compile_factor(shape)).cast("bigint"))
        return F.when(base <= 0, F.lit(0).cast("bigint")).otherwise(cost)


def probe_summary(t_ms: Column) -> Column:
    """(s_ms, r_ms, contaminated) of four probe times: steady time, compile overhead, disagreement over 25 %."""
    t = [F.element_at(t_ms, i) for i in (1, 2, 3, 4)]
    s = (t[2] + t[3]) / 2.0
    return F.struct(s.alias("s_ms"), (t[0] + t[1] - F.lit(2.0) * s).alias("r_ms"), ((s > 0) & (F.abs(t[2] - t[3]) / F.when(s > 0, s) > 0.25)).alias("contaminated"))


def gpu_multiplier(s_ms: Column) -> Column:
    return F.when(s_ms > 0, s_ms / 1000.0 / REFERENCE_SECONDS).otherwise(F.lit(1.0))


#: The default table and executors in DuckDB SQL, for the oracles.
SQL = """
timing AS (
  SELECT b AS bucket, f * (1e0 + 2e-2 * ((b // 64) % 3)) AS inf, 1e0 + 5e-2 * ((b // 64) % 5) AS comp
  FROM (SELECT b, greatest(1e0 + 33e-2 * (u - 1e0) + 42e-2 * (u * u - 1e0) + 27e-2 * (u * u * u - 1e0), 1e-6) AS f
        FROM (SELECT b, b::DOUBLE / 1024e0 AS u FROM (SELECT unnest(range(64, 5121, 64))::BIGINT AS b)))),
executors AS (
  SELECT s_suppkey AS slot, s_nationkey::BIGINT AS kind,
         20000000 + 1000000 * s_nationkey::BIGINT AS compile_us, 50000000 + 3000000 * (s_nationkey::BIGINT % 7) AS infer_us
  FROM supplier),
kinds AS (SELECT DISTINCT kind, compile_us, infer_us FROM executors),
jobs AS (SELECT doc_id AS job_id, n_chars AS tokens, 1 + doc_id % 5 AS n_seeds FROM documents),
covered AS (
  SELECT j.*, CASE WHEN tokens <= 5120 THEN (SELECT min(bucket) FROM timing WHERE bucket >= tokens) ELSE (tokens + 63) // 64 * 64 END AS shape
  FROM jobs j),
shapes AS (SELECT shape, sum(n_seeds)::BIGINT AS units, count(*) AS n_jobs FROM covered GROUP BY shape),
factors AS (
  SELECT s.shape, CASE WHEN s.shape > 5120
      THEN greatest(1e0 + 33e-2 * (s.shape / 1024e0 - 1e0) + 42e-2 * ((s.shape / 1024e0) * (s.shape / 1024e0) - 1e0)
                    + 27e-2 * ((s.shape / 1024e0) * (s.shape / 1024e0) * (s.shape / 1024e0) - 1e0), 1e-6)
      ELSE t.inf END AS inf, coalesce(t.comp, last.comp) AS comp
  FROM (SELECT DISTINCT shape FROM covered) s LEFT JOIN timing t ON t.bucket = s.shape
  CROSS JOIN (SELECT comp FROM timing WHERE bucket = 5120) last),
costs AS (
  SELECT k.kind, f.shape, greatest(0, round_even(k.compile_us * f.comp, 0)::BIGINT) AS compile_cost,
         greatest(1, round_even(k.infer_us * f.inf, 0)::BIGINT) AS infer_cost
  FROM kinds k CROSS JOIN factors f)
"""
