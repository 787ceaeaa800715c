"""One document a record: a writer that gathers what is wrong with single records.

``df.write.format("documents").option("path", ...).mode("append").save()``
writes (name, document) rows as ``<path>/part-<n>/<name>.json``.  A task writes
to a staging folder of its own; a commit renames the folders of the tasks that
ended well, one rename a task, and writes the report of all records that could
not be written.  A job that fails leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: A report names so many wrong records of each task; it counts all, and the task's own file has all.
SHOWN = 20


class DocumentSink(DataSource):
    """Options: path (a folder), report (its name there, ``_report.json``), strict (``true``: a wrong record fails the job)."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"name", "document"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"no column {sorted(missing)}")
        return DocumentWriter(self.options["path"], self.options.get("report", "_report.json"), self.options.get("strict", "false") == "true", overwrite)


@dataclass
class Written(WriterCommitMessage):
    """What a task left: its folder, how many documents, how many wrong records and the first of them."""

    part: int
    folder: str
    n_written: int
    n_wrong: int
    first: list[dict] = field(default_factory=list)


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, report: str, strict: bool, overwrite: bool):
        self.path, self.report, self.strict, self.overwrite, self.job = path.rstrip("/"), report, strict, overwrite, uuid.uuid4().hex

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        system, base = self._system()
        part = context.partitionId()
        folder = f"_staging-{self.job}/part-{part:06d}-{context.taskAttemptId()}"
        system.create_dir(f"{base}/{folder}")
        seen: set[str] = set()
        done, wrong, first, errors = 0, 0, [], None
        for row in iterator:
            why = self._why(row, seen)
            if why is None:
                seen.add(row.name)
                with system.open_output_stream(f"{base}/{folder}/{row.name}.json") as out:
                    out.write(row.document.encode())
                done += 1
                continue
            if self.strict:
                raise ValueError(f"{row.name}: {why}")
            entry = {"name": row.name, "error": why} | ({"line": row.line} if "line" in row else {})
            if errors is None:
                errors = system.open_output_stream(f"{base}/{folder}/_errors.jsonl")
            errors.write((json.dumps(entry) + "\n").encode())
            wrong += 1
            if len(first) < SHOWN:
                first.append(entry)
        if errors is not None:
            errors.close()
        return Written(part, folder, done, wrong, first)

    @staticmethod
    def _why(row: Row, seen: set[str]) -> str | None:
        """What is wrong with a record, or None."""
        if not row.name or row.name.startswith(("_", ".")) or "/" in row.name or "\0" in row.name or len(row.name.encode()) > 200:
            return "unusable name"
        if row.name in seen:
            return "name is taken"
        if row.document is None:
            return "no document"
        try:
            if not isinstance(json.loads(row.document), dict):
                return "not a JSON object"
        except ValueError as e:
            return f"not JSON: {e}"
        return None

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._system()
        told = [m for m in messages if m is not None]
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if old.base_name.startswith("part-") or old.base_name == self.report:
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        for m in told:
            system.move(f"{base}/{m.folder}", f"{base}/part-{m.part:06d}-{self.job[:8]}")
        report = {"written": sum(m.n_written for m in told), "wrong": sum(m.n_wrong for m in told), "first": [e for m in told for e in m.first][:SHOWN]}
        with system.open_output_stream(f"{base}/{self.report}") as out:
            out.write((json.dumps(report, sort_keys=True) + "\n").encode())
        self._drop_staging()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        system, base = self._system()
        if system.get_file_info(f"{base}/_staging-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base}/_staging-{self.job}")
