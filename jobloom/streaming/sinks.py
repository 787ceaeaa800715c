"""Sinks of event logs and verdicts: a batch that is replayed changes nothing.

Both are plain functions for ``foreachBatch``.  Each micro-batch writes to a
folder of its own number, in overwrite mode, so running it again after a
failure writes the same rows to the same place.

``Upserted`` is a table that is merged when read: each batch leaves the last row
of each of its keys (a delta); every ``every`` batches all that is there becomes
a base.  A batch costs what it holds, not what the table holds, and a read
merges one base and at most ``2 * every`` deltas.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of complete folders ``name=n`` below ``path``, ascending."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(there):
        return []
    found = [(re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()), s.getPath()) for s in files.listStatus(there)]
    return sorted(int(m.group(1)) for m, p in found if m and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


class Appended:
    """Rows of a stream, each once: ``write`` for ``foreachBatch``, ``read`` for all of them."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self, spark: SparkSession, schema: str | None = None) -> DataFrame:
        """All rows of complete batches; of an empty log none, with the given schema."""
        done = _numbers(spark, self.path, "batch")
        if not done:
            if schema is None:
                raise ValueError(f"no batch was written to {self.path}")
            return spark.createDataFrame([], schema)
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(*(f"{self.path}/batch={n}" for n in done))


class Upserted:
    """Of all rows of a key the one that is last by ``order`` stands; ``n_rows`` counts those it replaced and itself.

    Rows that tie in ``order`` are told apart by their other columns, the
    greatest stands: the result depends on the rows only, not on the batches
    they came in.  ``schema`` is that of the rows (columns ``keys``, ``order``
    and others, of types that have an order).
    """

    def __init__(self, path: str, schema: str, keys: list[str], order: list[str], every: int = 16):
        self.path, self.keys, self.order, self.every = path.rstrip("/"), keys, order, every
        self.names = [c for c in _names(schema) if c not in keys and c not in order]
        self.stored = f"{schema}, n_rows bigint"

    def _merged(self, rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, *self.names)).alias("_last"), F.sum("n_rows").alias("n_rows"))
        return last.select(*self.keys, *(F.col("_last")[c].alias(c) for c in (*self.order, *self.names)), "n_rows").select(*_names(self.stored))

    def _parts(self, spark: SparkSession, before: int | None = None) -> tuple[list[int], list[int]]:
        """(the base in use, deltas behind it), of batches before the given one."""
        ok = lambda n: before is None or n < before
        bases = [n for n in _numbers(spark, f"{self.path}/base", "upto") if ok(n)][-1:]
        return bases, [n for n in _numbers(spark, f"{self.path}/delta", "batch") if ok(n) and n > (bases or [-1])[0]]

    def _read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        bases, deltas = self._parts(spark, before)
        paths = [f"{self.path}/base/upto={n}" for n in bases] + [f"{self.path}/delta/batch={n}" for n in deltas]
        return spark.read.schema(self.stored).parquet(*paths) if paths else spark.createDataFrame([], self.stored)

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        self._merged(batch.withColumn("n_rows", F.lit(1).cast("bigint"))).write.mode("overwrite").parquet(f"{self.path}/delta/batch={number}")
        if number % self.every == self.every - 1:
            self._merged(self._read(spark, number).unionByName(spark.read.schema(self.stored).parquet(f"{self.path}/delta/batch={number}"))).write.mode("overwrite").parquet(f"{self.path}/base/upto={number}")
            # what this base was made from stays until the next one, for readers and a replay
            older = [n for n in _numbers(spark, f"{self.path}/base", "upto") if n < number]
            for n in older[:-1]:
                _delete(spark, f"{self.path}/base/upto={n}")
            for n in _numbers(spark, f"{self.path}/delta", "batch"):
                if older and n <= older[-1]:
                    _delete(spark, f"{self.path}/delta/batch={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._merged(self._read(spark))


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()


def into(stream: DataFrame, sink: Appended | Upserted, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream into a sink; ``trigger`` as for ``writeStream.trigger``: all that is there now, unless it says otherwise."""
    writer: DataStreamWriter = stream.writeStream.foreachBatch(sink.write).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# ---------------------------------------------------------------- verdicts

VERDICT = "job string, verdict string, ts double, slot string, error string"


def verdicts(events: DataFrame) -> DataFrame:
    """(job, verdict, ts, slot, error): done and failed jobs of an event stream; of each job the sink keeps the last of both."""
    ended = events.filter("job is not null and event in ('job_done', 'job_failed')")
    return ended.select("job", F.when(F.col("event") == "job_done", "done").otherwise("failed").alias("verdict"), F.coalesce("ts", F.lit(float("-inf"))).alias("ts"), "slot", "error")


def verdict_sink(path: str, every: int = 16) -> Upserted:
    return Upserted(path, VERDICT, ["job", "verdict"], ["ts"], every)


def standing(kept: DataFrame) -> DataFrame:
    """The verdicts that stand: a job that is done again loses its failure; one that fails again keeps having been done."""
    done = kept.filter("verdict = 'done'").select("job", F.col("ts").alias("done_ts"))
    return kept.join(done, "job", "left").filter("verdict = 'done' or done_ts is null or ts > done_ts").drop("done_ts")
