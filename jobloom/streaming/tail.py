"""A source over growing JSON-lines logs: byte ranges, read by the executors.

Spark's file stream takes each file once; executors' logs are appended to.  An
offset is a size in bytes a file, so planning a batch lists files and reads
none of them.  What was appended is cut into ranges of at most ``part_bytes``,
each a partition.  A line belongs to the range that holds its newline: a range
that begins inside a line reads back to the line's start, and a line that is
still being written waits for the range in which it ends.  So every line is
read once, whole, whatever the cuts, and a batch that is run again after a
restart reads the same lines.

Files are found by ``pyarrow.fs``: a path or URI that all executors share.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

BLOCK = 1 << 20
PART_BYTES = 64 << 20
SCHEMA = "file string, line string, at long"


class ByteRange(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class LogTail(DataSource):
    """(file, line, at): lines that are not blank, with the byte at which each begins.

    Options: path (a folder), suffix (``.jsonl``), start (``earliest`` or
    ``latest``; streams only), part_bytes.  ``at`` tells a file's lines apart
    and orders them.  A file that shrinks gives no lines until it has grown
    beyond what was read.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def _logs(self) -> Logs:
        return Logs(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("part_bytes", PART_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self._logs())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(self._logs(), self.options.get("start", "earliest"))


class Logs:
    def __init__(self, path: str, suffix: str, part_bytes: int):
        self.path, self.suffix, self.part_bytes = path, suffix, part_bytes

    def sizes(self) -> dict[str, int]:
        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.is_file and f.base_name.endswith(self.suffix)}

    def ranges(self, start: dict, end: dict) -> list[ByteRange]:
        out = []
        for name in sorted(end):
            at = int(start.get(name, 0))
            while at < int(end[name]):
                out.append(ByteRange(name, at, min(at + self.part_bytes, int(end[name]))))
                at = out[-1].end
        return out

    def lines(self, part: ByteRange) -> Iterator[tuple[int, bytes]]:
        """(start, line) of each line whose newline lies in the range, a block at a time."""
        system, base = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(f"{base}/{part.file}") as f:
            at = held_at = self._line_start(f, part.start)
            held: list[bytes] = []
            while at < part.end:
                f.seek(at)
                block = f.read(min(BLOCK, part.end - at))
                if not block:
                    return  # the file was cut short
                done = 0
                while (cut := block.find(b"\n", done)) >= 0:
                    if at + cut >= part.start:
                        yield held_at, b"".join([*held, block[done:cut]])
                    done, held, held_at = cut + 1, [], at + cut + 1
                if done < len(block):
                    held.append(block[done:])
                at += len(block)

    @staticmethod
    def _line_start(f, at: int) -> int:
        """Where the line that holds byte ``at`` begins: behind the last newline before it."""
        while at > 0:
            low = max(0, at - (BLOCK // 16 + 1))
            f.seek(low)
            cut = f.read(at - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
        return 0

    def batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for at, line in self.lines(part):
            if line.strip():
                out.append((at, line.rstrip(b"\r").decode("utf-8", "replace")))
                size += len(line)
                if size > BLOCK:
                    yield self._batch(part.file, out)
                    out, size = [], 0
        if out:
            yield self._batch(part.file, out)

    @staticmethod
    def _batch(name: str, out: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([x[1] for x in out]), pa.array([x[0] for x in out], pa.int64())], ["file", "line", "at"])


class LogReader(DataSourceReader):
    """The logs as they are now."""

    def __init__(self, logs: Logs):
        self.logs = logs

    def partitions(self) -> list[ByteRange]:
        return self.logs.ranges({}, self.logs.sizes()) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.logs.batches(partition) if partition.end else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, logs: Logs, start: str):
        if start not in ("earliest", "latest"):
            raise ValueError(f"start is earliest or latest, not {start}")
        self.logs, self.start = logs, start

    def initialOffset(self) -> dict:  # noqa: N802
        return self.logs.sizes() if self.start == "latest" else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.logs.sizes()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return self.logs.ranges(start, end)

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return self.logs.batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing to give back: logs stay, and the checkpoint holds the offsets."""
