"""Bounded samples of distinct rows, chosen by least hash.

A sorted limit would have every task send as many whole rows as the sample
holds, and conditions would be tested on all rows.  Here only rows whose hash
lies below a share of the hash space are looked at; the share is raised until
enough of them meet the condition.  The least hashes are found first, eight
bytes each, and only the rows that have them leave their tasks; copies are
merged before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: How many times the wanted rows are looked at first, and by what the share is raised.
FIRST, RAISE = 16, 8


def least_hash(rows: DataFrame, groups: list[Column], limit: int) -> list[list[Row]]:
    """For each condition, at most ``limit`` distinct rows that meet it, those of least hash.

    Whole groups where they have no more rows than ``limit``; the same rows
    each time, in the order of their hashes.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    total, out = rows.count(), []
    for g in groups:
        share, least = min(1.0, FIRST * limit / max(total, 1)), []
        while True:
            some = hashed if share >= 1 else hashed.filter(F.col("_hash") < int(-(2**63) + share * 2**64))  # before the condition, which costs more
            least = [r[0] for r in some.filter(g).select("_hash").distinct().orderBy("_hash").limit(limit).collect()]
            if len(least) >= limit or share >= 1:
                break
            share = min(1.0, share * RAISE)
        if not least:
            out.append([])
            continue
        one = some.filter(F.col("_hash") <= least[-1]).filter(g).groupBy("_hash").agg(F.first(F.struct(*rows.columns)).alias("row"))
        out.append([r.row for r in sorted(one.collect(), key=lambda r: r["_hash"])])  # at most ``limit``
    return out
