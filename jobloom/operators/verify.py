"""A fast path that is checked on its first results and given up at the first difference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.registry import query, table

Path = Callable[[pd.DataFrame], pd.Series]


def verified(rows: DataFrame, slot: str, order: list[str], fast: Path, plain: Path, result: str, first: int = 3, out: str = "result") -> DataFrame:
    """``rows`` with ``out`` (of type ``result``), ``path`` and ``checked``: each slot's rows by the fast path, as long as that is right.

    The first ``first`` rows of a slot, in ``order``, go both ways.  Where a
    result differs, or the fast path fails, this row and all later ones of the
    slot take the plain path.  Both get a DataFrame of rows and give a Series;
    results are compared as values, two nulls being equal.  A slot is a queue of
    one executor: it is streamed through one task, batch by batch, and what is
    carried is a counter and a flag.
    """
    names = rows.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {out} {result}, path string, checked boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, ok = object(), 0, True
        for batch in batches:
            parts = []
            for key, part in batch.groupby(batch[slot].ne(batch[slot].shift()).cumsum(), sort=False):
                value = part[slot].iloc[0]
                if not (value == now or (pd.isna(value) and now is None)):
                    now, seen, ok = (None if pd.isna(value) else value), 0, True
                left = part
                while len(left):
                    checking = ok and seen < first
                    some = left.iloc[: first - seen] if checking else left
                    got, path = None, "plain"
                    if ok:
                        try:
                            got = fast(some)
                        except Exception:  # noqa: BLE001  any failure of the fast path is one
                            got = None
                    if checking:
                        want = plain(some)
                        same = [False] * len(some) if got is None else [a == b or (pd.isna(a) and pd.isna(b)) for a, b in zip(got, want, strict=True)]
                        n = same.index(False) if False in same else len(some)
                        ok, seen = n == len(some), seen + len(some)
                        path = ["fast"] * n + ["plain"] * (len(some) - n)
                        # rows behind the first difference were compared only because they came together: they count as plain
                        checked = [True] * min(n + 1, len(some)) + [False] * (len(some) - n - 1)
                        got = want
                    else:
                        ok = ok and got is not None
                        path, checked = ("fast" if ok else "plain"), False
                        got = got if ok else plain(some)
                    parts.append(some.assign(**{out: list(got), "path": path, "checked": checked}))
                    left = left.iloc[len(some) :]
            yield pd.concat(parts)[[*names, out, "path", "checked"]] if parts else pd.DataFrame(columns=[*names, out, "path", "checked"])

    return rows.repartition(slot).sortWithinPartitions(slot, *order).mapInPandas(run, schema)


@query("""WITH n AS (SELECT l_suppkey AS slot, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS i, l_orderkey % 11 = 0 AS wrong FROM lineitem),
b AS (SELECT slot, min(i) FILTER (wrong AND i <= 3) AS bad FROM n GROUP BY slot)
SELECT slot, l_orderkey, l_linenumber, CASE WHEN bad IS NULL AND wrong THEN 2 * l_orderkey + 1 ELSE 2 * l_orderkey END AS result, CASE WHEN bad IS NULL OR i < bad THEN 'fast' ELSE 'plain' END AS path, i <= least(3, coalesce(bad, 3)) AS checked
FROM n JOIN b USING (slot)""")
def verified_first(spark: SparkSession, d: str) -> DataFrame:
    """A fast path that errs on some rows: slots that notice it among their first three turn it off."""
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("slot"), "l_orderkey", "l_linenumber")
    return verified(lines, "slot", ["l_orderkey", "l_linenumber"], lambda p: 2 * p["l_orderkey"] + (p["l_orderkey"] % 11 == 0), lambda p: 2 * p["l_orderkey"], "bigint")
