from __future__ import annotations

import json
import os
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from jobloom.streaming import progress, sinks, tail

SMALL = 64


def line(**k) -> str:
    return json.dumps(k) + "\n"


def logs_of(path, part_bytes=SMALL) -> tail.Logs:
    return tail.Logs(str(path), ".jsonl", part_bytes)


def read(logs: tail.Logs, start: dict, end: dict) -> list[tuple[str, int, str]]:
    out = []
    for part in logs.ranges(start, end):
        for batch in logs.batches(part):
            out += [(r["file"], r["at"], r["line"]) for r in batch.to_pylist()]
    return out


# ---------------------------------------------------------------- tail


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_every_line_is_read_once_whatever_the_cuts(tmp_path, monkeypatch, block):
    monkeypatch.setattr(tail, "BLOCK", block)
    rnd = random.Random(block)
    want, at = [], 0
    with (tmp_path / "a.jsonl").open("wb") as f:
        for k in range(200):
            text = ("é" * rnd.randint(0, 90) + str(k)).encode() if k % 9 else b""
            f.write(text + (b"\r\n" if k % 5 == 0 else b"\n"))
            if text:
                want.append(("a.jsonl", at, text.decode()))
            at += len(text) + (2 if k % 5 == 0 else 1)
        f.write(b"half")
    (tmp_path / "empty.jsonl").touch()
    (tmp_path / "other.txt").write_text("not a log\n")
    for part_bytes in (1, 13, 64, 1 << 20):
        logs = logs_of(tmp_path, part_bytes)
        assert read(logs, {}, logs.sizes()) == want
    logs, cuts = logs_of(tmp_path), sorted(rnd.randint(0, at) for _ in range(20))
    got = []
    for a, b in zip([0, *cuts], [*cuts, at + 4], strict=True):
        got += read(logs, {"a.jsonl": a}, {"a.jsonl": b})
    assert got == want


def test_half_written_lines_wait_and_a_replay_reads_the_same(tmp_path):
    (tmp_path / "g.jsonl").write_text("one\ntw")
    reader = tail.LogStreamReader(logs_of(tmp_path), "earliest")
    first = reader.latestOffset()
    assert [x[2] for x in read(reader.logs, reader.initialOffset(), first)] == ["one"]
    with (tmp_path / "g.jsonl").open("a") as f:
        f.write("o\nthree\nfou")
    second = reader.latestOffset()
    for _ in range(2):
        assert [x[1:] for x in read(reader.logs, first, second)] == [(4, "two"), (8, "three")]
    assert tail.LogStreamReader(logs_of(tmp_path), "latest").initialOffset() == second
    (tmp_path / "g.jsonl").write_text("cut\n")
    assert read(reader.logs, second, reader.latestOffset()) == []
    assert read(reader.logs, first, second) == []
    with pytest.raises(ValueError, match="earliest or latest"):
        tail.LogStreamReader(reader.logs, "middle")
    assert logs_of(tmp_path / "nowhere").sizes() == {}


def test_source_as_a_table_and_as_a_stream_that_restarts(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "gpu0.jsonl").write_text("".join(line(n=k) for k in range(50)))
    spark.dataSource.register(tail.LogTail)
    table = spark.read.format("jsonl_tail").option("path", str(logs)).option("part_bytes", "100").load()
    assert table.rdd.getNumPartitions() > 3
    assert [json.loads(r.line)["n"] for r in table.orderBy("at").collect()] == list(range(50))
    out = sinks.Appended(str(tmp_path / "out"))

    def go() -> list[int]:
        stream = spark.readStream.format("jsonl_tail").option("path", str(logs)).option("part_bytes", "100").load()
        q = sinks.into(stream, out, str(tmp_path / "cp"))
        q.awaitTermination()
        return sorted(json.loads(r.line)["n"] for r in out.read(spark).collect())

    assert go() == list(range(50))
    with (logs / "gpu0.jsonl").open("a") as f:
        f.write(line(n=50) + '{"n": 5')
    (logs / "gpu1.jsonl").write_text(line(n=100))
    assert go() == [*range(51), 100]
    with (logs / "gpu0.jsonl").open("a") as f:
        f.write("1}\n")
    assert go() == [*range(52), 100]
    assert spark.read.format("jsonl_tail").option("path", str(tmp_path / "nowhere")).load().collect() == []


# ---------------------------------------------------------------- progress


def rows_of(spark, name: str) -> list:
    return spark.sql(f"select * from {name}").collect()


def test_progress_counts_places_skips_and_goes_stale(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    spark.dataSource.register(tail.LogTail)
    (logs / "gpu0.jsonl").write_text(
        line(event="job_start", ts=1.0, job="a", shape=128, tokens=10) + "broken\n" + line(event="job_done", ts=2.0, job="a", shape=128) + line(event="job_done", ts=2.5, job="a", shape=128)
        + line(event="job_skip", ts=9.0, job="z", shape=256) + line(event="note", ts=9.5, job="q") + line(event="job_done", ts=3.0, job="b", shape=256) + line(event="job_done", ts=0.5, job="late", shape=64) + '{"event":"job_d'
    )
    places = spark.createDataFrame([("gpu0", "a", 0, 1), ("gpu0", "b", 1, 7)], "slot string, job string, ordinal int, place int")
    stream = progress.with_places(progress.events(spark.readStream.format("jsonl_tail").option("path", str(logs)).load()), places)
    q = progress.progress(stream, stale_after="2 seconds").writeStream.format("memory").queryName("progress_rows").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()

    def until(ok) -> list:
        end = time.time() + 90
        while time.time() < end and not (got := [r for r in rows_of(spark, "progress_rows") if ok(r)]):
            time.sleep(0.5)
        return got

    try:
        first = until(lambda r: r.done == 3)[0]
        assert tuple(first) == ("gpu0", 3, "b", 256, -1, 1, 7, False)
        assert tuple(until(lambda r: r.stale)[0]) == ("gpu0", 3, "b", 256, -1, 1, 7, True)
        with (logs / "gpu0.jsonl").open("a") as f:
            f.write('one","ts":4.0,"job":"a","shape":128}\n' + line(event="job_start", ts=5.0, job="unplanned", shape=512, tokens=400))
        assert tuple(until(lambda r: r.current == "unplanned")[0]) == ("gpu0", 3, "unplanned", 512, 400, -1, -1, False)
    finally:
        q.stop()


def test_progress_equals_distinct_counts_over_many_batches(spark, tmp_path):
    rnd = random.Random(2)
    data = [(f"s{rnd.randint(0, 4)}", rnd.choice(["job_done", "job_start", "job_skip"]), float(k), f"j{rnd.randint(0, 60)}", None, None) for k in range(800)]
    spark.createDataFrame(data, "slot string, event string, ts double, job string, shape long, tokens long").repartition(8).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slot string, event string, ts double, job string, shape long, tokens long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    sink = sinks.Upserted(str(tmp_path / "out"), "slot string, done bigint, current string", ["slot"], ["done"])
    sinks.into(progress.progress(stream, None, None).select("slot", "done", "current"), sink, str(tmp_path / "cp")).awaitTermination()
    got = {r.slot: r.done for r in sink.read(spark).collect()}
    assert got == {s: len({d[3] for d in data if d[0] == s and d[1] == "job_done"}) for s in {d[0] for d in data}}
    counted = progress.job_counts(spark.createDataFrame(data, stream.schema).withColumn("infer_ms", F.lit(1.0))).filter("done").groupBy("slot").count().collect()
    assert {r.slot: r["count"] for r in counted} == got


class Calls:
    """Map or value state in memory that counts the messages a state store would get."""

    def __init__(self, calls: list):
        self.calls, self.value, self.map = calls, None, {}

    def __getattr__(self, name: str):
        told = {"get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "exists": lambda: self.value is not None, "keys": lambda: iter(list(self.map)), "containsKey": lambda k: k in self.map, "updateValue": self.map.__setitem__}[name]
        return lambda *args: (self.calls.append(name), told(*args))[1]


def test_progress_asks_the_state_once_a_job():
    """500 events of three jobs: a message an event took over 1,000."""
    calls, rnd = [], random.Random(5)
    p = progress.Progress(None, None)
    p.now, p.jobs = Calls(calls), Calls(calls)
    event = lambda k, job: Row(event="job_done", ts=float(k) if k % 7 else None, job=job, shape=None, tokens=k, ordinal=-1, place=-1)
    seen = set()
    for batch in (["a", "b"], ["a", "b", "c"], ["a", "c"], [f"j{k}" for k in range(40)], ["x"]):
        jobs = [rnd.choice(batch) for _ in range(500)]
        calls.clear()
        (got,) = p.handleInputRows(("s",), iter([event(k, j) for k, j in enumerate(jobs)]), None)
        seen |= set(jobs)
        assert got.done == len(seen) == len(p.jobs.map) and (got.current, got.tokens) == (jobs[499], 499)
        assert len(calls) <= 3 + 2 * len(batch)


def test_stream_static_join_drops_late_windows(spark, tmp_path):
    jobs = spark.createDataFrame([("a", 10), ("b", 20)], "job string, tokens long")
    schema = "job string, tokens long, at timestamp"
    for k, rows in enumerate(([("a", None, 100), ("b", 7, 160), (None, None, 170)], [("x", None, 4000)], [("x", None, 4005)], [("a", None, 120), ("b", None, 4010)])):
        spark.createDataFrame(rows, "job string, tokens long, s long").select("job", "tokens", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/f={k}"))
        for f in (tmp_path / f"in/f={k}").glob("*.parquet"):
            os.utime(f, (1_000_000 + 100 * k, 1_000_000 + 100 * k))  # files arrive in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    joined = progress.with_jobs(stream, jobs, delay="1 minute")
    kept = sinks.Appended(str(tmp_path / "rows"))
    sinks.into(joined, kept, str(tmp_path / "cp1")).awaitTermination()
    assert sorted(((r.job, r.tokens) for r in kept.read(spark).collect()), key=repr) == [("a", 10), ("a", 10), ("b", 20), ("b", 7), ("x", None), ("x", None), (None, None)]
    windows = joined.groupBy(F.window("at", "1 minute").alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    closed = sinks.Appended(str(tmp_path / "windows"))
    writer = windows.writeStream.foreachBatch(closed.write).outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True)
    writer.start().awaitTermination()
    assert sorted((r.w.start.minute, r.tokens, r.n) for r in closed.read(spark).collect())[:2] == [(1, 10, 1), (2, 7, 2)]


# ---------------------------------------------------------------- sinks


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    rnd = random.Random(1)
    batches = [[(f"k{rnd.randint(0, 9)}", rnd.randint(0, 20), f"v{rnd.randint(0, 3)}") for _ in range(30)] for _ in range(9)]
    schema = "k string, t int, v string"
    up, log = sinks.Upserted(str(tmp_path / "up"), schema, ["k"], ["t"], every=3), sinks.Appended(str(tmp_path / "log"))
    assert up.read(spark).collect() == [] and log.read(spark, schema).collect() == []
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        want = sorted((k, *max((t, v) for x, t, v in seen if x == k), sum(x == k for x, _, _ in seen)) for k in {x[0] for x in seen})
        for _ in range(2):  # once more, as after a failure
            up.write(spark.createDataFrame(rows, schema), n)
            log.write(spark.createDataFrame(rows, schema), n)
            assert sorted(map(tuple, up.read(spark).collect())) == want
        assert sorted(map(tuple, log.read(spark).collect())) == sorted(seen)
    bases, deltas = up._parts(spark)
    assert bases == [8] and deltas == []
    assert sinks._numbers(spark, str(tmp_path / "up/base"), "upto") == [5, 8]
    assert sinks._numbers(spark, str(tmp_path / "up/delta"), "batch") == [6, 7, 8]
    (tmp_path / "up/delta/batch=9").mkdir()  # a batch that was never finished
    assert sorted(map(tuple, up.read(spark).collect())) == want


def test_verdicts_that_stand(spark, tmp_path):
    rows = [("a", "job_failed", 1.0, "oom"), ("a", "job_done", 2.0, None), ("b", "job_done", 1.0, None), ("b", "job_failed", 3.0, "disk"), ("c", "job_failed", 1.0, "x"), ("c", "job_failed", 5.0, "y"), ("d", "job_start", 1.0, None), (None, "job_done", 1.0, None), ("e", "job_done", None, None)]
    events = spark.createDataFrame([("s", *r) for r in rows], "slot string, job string, event string, ts double, error string")
    sink = sinks.verdict_sink(str(tmp_path / "v"), every=2)
    for n in range(3):
        sink.write(sinks.verdicts(events.filter(F.expr(f"pmod(hash(ts, error), 3) = {n}"))), n)
    got = {(r.job, r.verdict): r.error for r in sinks.standing(sink.read(spark)).collect()}
    assert got == {("a", "done"): None, ("b", "done"): None, ("b", "failed"): "disk", ("c", "failed"): "y", ("e", "done"): None}
