"""Connected components of a link table, as a contraction of stars.

Each task first contracts the links it holds: every node points to the least
node that its task knows to be connected with it.  So a node has at most one
row a task, and no node's neighbourhood is gathered anywhere.  A round then
brings the rows of each node together, contracts them again, and has every node
point to what its root points to (pointer jumping, a grouped minimum and one
join); rounds end when nothing changes, and their number grows with the
logarithm of the longest chain between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm._shared import released
from jobloom.storage import discard, materialize

#: Rows that a task contracts at most.
TASK_ROWS = 1 << 20
#: Bytes of a link.
WIDTH = 16


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node connected with it) of all nodes that are not the least."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


@released
def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([r.column(k).to_numpy() for r in rows]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(z) for z in stars_of(a, b)], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= TASK_ROWS:
            yield made(held)
            held, size = [], 0
    if held:
        yield made(held)


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50, n_links: int | None = None) -> DataFrame:
    """(node, component): each linked node with the least node reachable from it, as a written table.

    Nodes without a link have no row; links to oneself and repeated links
    count for nothing; null ends are dropped.  Contractions that are not stable
    after ``most_rounds`` raise an error, as their stars may be split components.
    ``n_links``: about how many links there are, for the number of files.
    """
    spark = links.sparkSession
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna().filter("a <> b")
    edges, before = materialize(ends.mapInArrow(_contract, "a long, b long"), "stars", size=None if n_links is None else WIDTH * n_links), None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        parts = max(least_parts, -(-now[0] // (TASK_ROWS // 2)))
        size = WIDTH * now[0]  # contracting makes no more rows
        met = materialize(edges.repartition(parts, "a").mapInArrow(_contract, "a long, b long"), "met", size=size)
        up = met.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "b")
        jumped = materialize(met.join(up, "b", "left").select("a", F.coalesce("root", "b").alias("b")), "stars", size=size)
        discard(met, edges)
        edges = jumped
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = materialize(leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct()), "components", size=2 * WIDTH * now[0])
    discard(edges)
    return out
