from __future__ import annotations

from pyspark.sql import functions as F

from jobloom.llm.sampling import least_hash


def test_samples_are_bounded_distinct_and_repeatable(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).alias("x"), F.lit(None).cast("string").alias("y"))
    groups = [F.col("x") % 2 == 0, F.col("x") < 30, F.col("x") < 0]
    a, b = least_hash(df, groups, 100), least_hash(df.repartition(7), groups, 100)
    assert a == b and [len(g) for g in a] == [100, 30, 0]
    assert len({r.x for r in a[0]}) == 100 and all(r.x % 2 == 0 for r in a[0]) and {r.x for r in a[1]} == set(range(30))
    want = df.distinct().filter("x % 2 = 0").orderBy(F.xxhash64("x", "y")).limit(100).collect()
    assert [r.x for r in a[0]] == [r.x for r in want]


def test_copies_of_one_row_count_once(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    assert len({r.x for r in least_hash(df, [F.col("x").isNotNull()], 50)[0]}) == 50
    assert least_hash(df.limit(0), [F.lit(True)], 5) == [[]]
