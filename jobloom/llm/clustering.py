"""Centroid clustering: Delta Lloyd over whole-number vectors.

The state of a round is a table of assignments (vector, owner, distance) in
the shared folder; the sums and sizes of all clusters are held beside it, k
rows of ``dims`` whole numbers.  A round compares each vector with the
centroids that changed, and only a vector whose own centroid moved with all of
them.  Each task adds up what changed owner as signed transfers, at most k
rows, and writes them behind its assignments, so a task that is run again
writes both anew or neither.  Transfers are added to the sums, which gives the
next centroids exactly: nothing is rounded, so the order of additions does not
matter.  Vectors are never shuffled.

Defined results: a vector that is null, has another length or a component that
is null or not finite gets no row; components are held within +-2**27 after
scaling, so every distance is an exact long; repeated rows and ids are vectors
of their own; a null id is never among the first centroids unless ids run out,
and ties of equal ids go to the vector that is less component by component;
fewer vectors than ``k`` give as many clusters; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.storage import discard, materialize

#: Scaled components beyond this are held at it: differences then square and add up within a long.
LIMIT = 1 << 27
#: Centroids travel to every task, so their number of components is bounded.
MAX_COMPONENTS = 1 << 22


class Clusters(NamedTuple):
    """``rows`` (id, v, cluster, distance), final centroids by number, and how many rounds compared vectors."""

    rows: DataFrame
    centroids: list[list[int]]
    compared: int


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): vectors of ``dims`` finite components, each as floor(scale * component)."""
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * float(scale), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    typed = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("e"))
    return typed.filter((F.size("e") == dims) & finite).select("id", whole.alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the least sha256 of ``seed:id``: a top-k of bounded size."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r.v) for r in whole.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector after a round; an owner of -1 means none so far.

    A vector whose centroid stands still keeps its distance and meets the
    changed centroids only; all others start anew and meet all.
    """
    k = len(centroids)
    anew = (owner < 0) | changed[owner]
    own = np.where(anew, k, owner)
    best = np.where(anew, np.iinfo(np.int64).max, distance)
    for j in range(k):
        rows = np.arange(len(v)) if changed[j] else np.flatnonzero(anew)
        if not len(rows):
            continue
        diff = v[rows] - centroids[j]
        d = np.einsum("ij,ij->i", diff, diff)
        closer = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
        own[rows[closer]], best[rows[closer]] = j, d[closer]
    return own, best


def _round(state: DataFrame, centroids: list[list[int]], changed: list[bool], dims: int) -> DataFrame:
    """The next state: assignments (``n`` null), and behind those of a task its transfers (cluster, n, sums)."""
    schema = f"id {state.schema['id'].dataType.simpleString()}, v array<int>, cluster int, distance bigint, n bigint, sums array<bigint>"
    at, moved, k = np.array(centroids, np.int64).reshape(-1, dims), np.array(changed), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, kind = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), None
        for batch in batches:
            ids, vectors, owner, distance = batch.columns
            kind = ids.type
            if not len(ids):
                continue
            v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            old, was = owner.to_numpy(zero_copy_only=False).astype(np.int64), distance.to_numpy(zero_copy_only=False).astype(np.int64)
            own, best = nearest(v, old, was, at, moved)
            for j in range(k):
                come, gone = (own == j) & (old != j), (old == j) & (own != j)
                sums[j] += v[come].sum(axis=0) - v[gone].sum(axis=0)
                sizes[j] += np.count_nonzero(come) - np.count_nonzero(gone)
            none = len(ids)
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(own, pa.int32()), pa.array(best, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64()))], ["id", "v", "cluster", "distance", "n", "sums"])
        some = np.flatnonzero(sizes.astype(bool) | sums.any(axis=1))
        if kind is not None and len(some):
            m = len(some)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, kind), pa.nulls(m, pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.nulls(m, pa.int64()), pa.array(sizes[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["id", "v", "cluster", "distance", "n", "sums"])

    return state.select("id", "v", "cluster", "distance").mapInArrow(run, schema)


def _transfers(state: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]]]:
    """(sizes, sums) that all tasks moved: k rows of ``dims`` numbers come to the driver."""
    sizes, sums = [0] * k, [[0] * dims for _ in range(k)]
    each = state.filter("n is not null").select("cluster", F.posexplode(F.array_prepend("sums", F.col("n"))).alias("at", "x"))
    for r in each.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():
        if r["at"]:
            sums[r["cluster"]][r["at"] - 1] = r["x"]
        else:
            sizes[r["cluster"]] = r["x"]
    return sizes, sums


def delta_lloyd(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding") -> Clusters | None:
    """Assign and replace ``rounds`` times, then assign once more; None if no vector is kept.

    A centroid is the componentwise floor of its vectors' mean; one without
    vectors stays.  Once no centroid changes, further rounds would change
    nothing, so they are left out.
    """
    if not 0 < k * dims <= MAX_COMPONENTS:
        raise ValueError(f"k * dims must be between 1 and {MAX_COMPONENTS}")
    whole = whole_vectors(vectors, dims, scale, id_col, vec_col)
    at = first_centroids(whole, k, seed)
    if not at:
        return None
    k, changed = len(at), [True] * len(at)
    total, size = [[0] * dims for _ in at], [0] * k
    source, state, compared = whole.select("id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), None, 0
    for n in range(rounds + 1):
        new = materialize(_round(source, at, changed, dims), "clusters")
        discard(state)
        state, compared = new, compared + 1
        source = state.filter("n is null")
        if n == rounds:
            break
        gained, moved = _transfers(state, k, dims)
        size = [a + b for a, b in zip(size, gained, strict=True)]
        total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(total, moved, strict=True)]
        after = [[x // size[j] for x in total[j]] if size[j] else at[j] for j in range(k)]
        changed = [a != b for a, b in zip(after, at, strict=True)]
        at = after
        if not any(changed):
            break
    return Clusters(source.select("id", "v", "cluster", "distance"), at, compared)


def cluster_digest(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    spark = vectors.sparkSession
    found = delta_lloyd(vectors, **options)
    id_col = options.get("id_col", "vec_id")
    kind = vectors.schema[id_col].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    own = {r["cluster"]: r["s"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    table = spark.createDataFrame([(j, s, sum(own.values()), digest[j]) for j, s in sorted(own.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.rows.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """The same in SQL, a pair of tables a round: all distances each time."""
    assign = f"""SELECT vec_id, any_value(v) AS v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (
      SELECT a.vec_id, a.v, b.c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))::BIGINT AS d FROM kept a CROSS JOIN {{0}} b) GROUP BY vec_id"""
    replace = f"""SELECT o.c, coalesce(m.v, o.v) AS v FROM {{0}} o LEFT JOIN (
      SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM {{1}}, range(1, {dims + 1}) r(i) GROUP BY c, i) GROUP BY c) m ON m.c = o.c"""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(1, rounds + 1):
        parts += [f"a{r} AS MATERIALIZED ({assign.format(f'c{r - 1}')})", f"c{r} AS MATERIALIZED ({replace.format(f'c{r - 1}', f'a{r}')})"]
    return f"""WITH {', '.join(parts)}, f AS MATERIALIZED ({assign.format(f'c{rounds}')})
    SELECT f.vec_id, f.c::INT AS cluster, f.d AS distance, (sum(f.d) OVER (PARTITION BY f.c))::BIGINT AS cluster_inertia, (sum(f.d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(z.v, ',')) AS centroid_sha256 FROM f JOIN c{rounds} z ON z.c = f.c"""


ORACLE = _oracle(8, 10, 64, 1024, 3)
