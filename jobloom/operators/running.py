"""Running sums and row numbers over groups of any size.

A window sorts each of its groups in one task.  Here rows are range-partitioned
by group and order, so a group that holds a third of all rows is spread over
many tasks; sums run inside each partition, and one row a partition and group
carries what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.storage import materialize


def running_totals(df: DataFrame, groups: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running sums in each group, in ``order``: ``values`` has the column to sum by the name of its sum.

    ``groups`` and ``order`` together should tell rows apart.  Materialised
    once sorted, so the partition numbers that the second level builds on do
    not change when a task is run again.
    """
    ranged = materialize(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()), next(iter(values)))
    sums = ranged.groupBy(*groups, "_part").agg(*(F.sum(v).alias(f"_sum_{out}") for out, v in values.items()))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, "_part", *(F.coalesce(F.sum(f"_sum_{out}").over(ahead), F.lit(0)).alias(f"_before_{out}") for out in values))
    here = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({out: F.sum(v).over(here) for out, v in values.items()}).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, "_part"]]
    both: Column = same[0]
    for x in same[1:]:
        both &= x
    kept = [F.col(f"r.{c}") for c in df.columns]
    return local.join(before.alias("b"), both).select(*kept, *((F.col(f"r.{out}") + F.col(f"b._before_{out}")).alias(out) for out in values))


def running_total(df: DataFrame, groups: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the inclusive running sum of ``value`` in each group, in ``order``."""
    return running_totals(df, groups, order, {out: value})


def row_numbers(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with each row's place in its group, from 1."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_total(counted, groups, order, "_one", out).drop("_one")
