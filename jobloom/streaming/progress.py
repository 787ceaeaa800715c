"""Progress of executors, kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "event string, ts double, job string, shape bigint, tokens bigint, seed bigint, feat_ms double, infer_ms double, n_seeds bigint, reason string, error string"
#: The state store that map state, timers and time to live need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
PROGRESS = "slot string, done bigint, current string, shape bigint, tokens bigint, ordinal int, place int, stale boolean"


def events(lines: DataFrame) -> DataFrame:
    """(slot, event fields, at): parsed lines, malformed ones and those without a kind dropped."""
    parsed = lines.select(F.regexp_replace("file", r"\.jsonl$", "").alias("slot"), F.from_json("line", EVENT).alias("e"))
    return parsed.filter("e.event is not null").select("slot", "e.*", F.timestamp_seconds("e.ts").alias("at"))


def job_events(stream: DataFrame) -> DataFrame:
    """The events that count as progress: of a job, and not a skip."""
    return stream.filter("job is not null and job <> '' and event in ('job_start', 'job_done')")


def with_jobs(stream: DataFrame, jobs: DataFrame, key: str = "job", size: str = "tokens", delay: str | None = None, at: str = "at") -> DataFrame:
    """The events with their job's size where they do not state it; events of unknown jobs stay.

    ``jobs`` (key, size) is a static table, one row a job, read anew for each
    micro-batch; with ``delay`` the stream gets a watermark on its column
    ``at``, so windows over the result close and late events are dropped there.
    """
    if delay is not None:
        stream = stream.withWatermark(at, delay)
    known = jobs.select(F.col(key).alias("_key"), F.col(size).alias("_known"))
    joined = stream.join(known, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(size, F.coalesce(size, "_known")).drop("_key", "_known")


def with_places(stream: DataFrame, places: DataFrame) -> DataFrame:
    """The events with where their job stands in the plan of their slot (``places``: slot, job, ordinal, place): -1 if nowhere."""
    where = places.select("slot", "job", F.col("ordinal").cast("int").alias("ordinal"), F.col("place").cast("int").alias("place"))
    return stream.join(where, ["slot", "job"], "left").fillna(-1, ["ordinal", "place"])


def job_counts(stream: DataFrame) -> DataFrame:
    """(slot, job, done, failed, infer_ms) in built-in state: a row a job, so no row grows and a job that reports twice is one."""
    jobs = stream.filter("job is not null and event <> 'job_skip'").groupBy("slot", "job")
    return jobs.agg((F.count_if(F.col("event") == "job_done") > 0).alias("done"), F.count_if(F.col("event") == "job_failed").alias("failed"), F.sum("infer_ms").alias("infer_ms"))


class Progress(StatefulProcessor):
    """A slot's state: one value for what it does now, and a map entry a done job.

    Entries live in the state store, not in a row that grows; each expires
    ``keep_ms`` after it was last reported.  A timer marks a slot as stale once
    nothing came from it for ``stale_ms``; its counts stay for when it returns.
    Either is left out where it is None.
    """

    def __init__(self, stale_ms: int | None, keep_ms: int | None):
        self.stale_ms, self.keep_ms = stale_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "done bigint, current string, shape bigint, tokens bigint, ordinal int, place int, ts double, due bigint")
        self.jobs = handle.getMapState("jobs", "job string", "ts double", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # each call to the state is a message: one a job and not one an event, and none for entries that a new slot cannot have
        state = self.now.get()
        done, current, shape, tokens, ordinal, place, last, due = (0, "", -1, -1, -1, -1, float("-inf"), -1) if state is None else state
        reported: dict[str, float] = {}
        for r in rows:
            ts = float("-inf") if r.ts is None or r.ts != r.ts else float(r.ts)
            if r.event == "job_done":
                reported[r.job] = ts
            if ts >= last:
                same = r.job == current
                known = lambda new, old: int(new) if new is not None else (old if same else -1)  # noqa: B023, E731
                shape, tokens = known(r.shape, shape), known(r.tokens, tokens)
                current, ordinal, place, last = r.job, int(r.ordinal), int(r.place), ts
        for job, ts in reported.items():
            new = state is None or not self.jobs.containsKey((job,))
            done += new
            if new or self.keep_ms is not None:
                self.jobs.updateValue((job,), (ts,))
        if due >= 0:
            self.handle.deleteTimer(due)
        due = -1
        if self.stale_ms is not None:
            due = timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
            self.handle.registerTimer(due)
        self.now.update((done, current, shape, tokens, ordinal, place, last, due))
        yield self._row(key[0], done, current, shape, tokens, ordinal, place, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.now.exists():
            done, current, shape, tokens, ordinal, place, last, due = self.now.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                self.now.update((done, current, shape, tokens, ordinal, place, last, -1))
                yield self._row(key[0], done, current, shape, tokens, ordinal, place, True)

    @staticmethod
    def _row(*values) -> Row:
        return Row(**{c.split()[0]: v for c, v in zip(PROGRESS.split(", "), values, strict=True)})

    def close(self) -> None:
        pass


def progress(stream: DataFrame, stale_after: str | None = "60 seconds", keep: str | None = "30 days") -> DataFrame:
    """(slot, done, current, shape, tokens, ordinal, place, stale): each slot's last job and how many it has done.

    ``stream`` (slot, event, ts, job, shape, tokens), and ordinal and place as
    ``with_places`` gives them, else -1.  Of a slot's events the latest says
    what is current.  A job is counted once; one that reports again later than
    ``keep`` after its last report counts again.  A slot without events for
    ``stale_after`` (processing time) is reported as stale once.  With both
    None no clock is involved, as for logs that are read to their end once:
    a clock keeps a query running, also under ``availableNow``.
    """
    spark = stream.sparkSession
    use_state_store(spark)
    millis = lambda text: None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)
    placed = stream if "ordinal" in stream.columns else stream.withColumns({"ordinal": F.lit(-1), "place": F.lit(-1)})
    rows = job_events(placed).select("slot", "event", "ts", "job", "shape", "tokens", "ordinal", "place")
    return rows.groupBy("slot").transformWithState(Progress(millis(stale_after), millis(keep)), PROGRESS, "Update", "None" if stale_after is None and keep is None else "ProcessingTime")


def use_state_store(spark: SparkSession) -> None:
    """A streaming query takes its state store from the session when it starts; one that was chosen is kept."""
    if spark.conf.get(STATE_STORE[0], "").endswith(".HDFSBackedStateStoreProvider") or not spark.conf.get(STATE_STORE[0], ""):
        spark.conf.set(*STATE_STORE)
