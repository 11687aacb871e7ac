"""Readable logs of verifier runs as a Spark data source: one text file for each file, function and finding.

    spark.dataSource.register(RunLogs)
    rows.write.format("run_logs").option("path", folder).mode("append").save()   # file, function, finding, log
    spark.read.format("run_logs").option("path", folder).load()

Each task writes into a folder of its own attempt below a staging folder; the commit renames the folders of the attempts
that count, one rename a task, and drops the rest. So a failed attempt or a failed job leaves no log.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, function string, finding string, log string"
STAGING, PART = "_staging-", "part-"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _folders(files, root: str, prefix: str) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(prefix))


def log_name(file: str | None, function: str | None, finding: str | None) -> str:
    """Stem, function and finding (direct where a whole file was run), and a digest of all three, so that no two keys share a name."""
    stem = re.sub(r"\.py$", "", re.split(r"[\\/]", file or "")[-1])
    shown = "_".join(re.sub(r"\W+", "-", p)[:60] for p in (stem, function or "direct", finding or "") if p)
    return f"{shown}.{hashlib.sha256(json.dumps([file, function, finding]).encode()).hexdigest()[:16]}.log"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    logs: int


class LogWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        files, root = _opened(self.path)
        folder, n = f"{PART}{uuid.uuid4().hex}", 0
        for n, r in enumerate(rows, 1):
            if n == 1:
                files.create_dir(f"{root}/{STAGING}{self.job}/{folder}", recursive=True)
            head = json.dumps({"file": r["file"], "function": r["function"], "finding": r["finding"], "log": r["log"] is not None})
            with files.open_output_stream(f"{root}/{STAGING}{self.job}/{folder}/{log_name(r['file'], r['function'], r['finding'])}") as f:
                f.write((head + "\n" + (r["log"] or "")).encode("utf-8", "replace"))
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _opened(self.path)
        files.create_dir(root, recursive=True)
        before = _folders(files, root, PART) if self.overwrite else []
        for m in messages:
            if m and m.logs:
                files.move(f"{root}/{STAGING}{self.job}/{m.folder}", f"{root}/{m.folder}")
        for old in before:
            files.delete_dir(old)
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, files, root: str) -> None:
        for left in _folders(files, root, STAGING + self.job):
            files.delete_dir(left)


@dataclass
class LogFolder(InputPartition):
    path: str


class LogReader(DataSourceReader):
    """A partition for each task's folder; logs are read one at a time."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[LogFolder]:
        return [LogFolder(p) for p in _folders(*_opened(self.path), PART)]

    def read(self, partition: LogFolder) -> Iterator[tuple]:
        from pyarrow import fs

        if not isinstance(partition, LogFolder):  # a source without any folder
            return
        files, _ = _opened(self.path)
        for info in files.get_file_info(fs.FileSelector(partition.path)):
            with files.open_input_stream(info.path) as f:
                head, _, log = f.read().decode("utf-8").partition("\n")
            told = json.loads(head)
            yield told["file"], told["function"], told["finding"], log if told["log"] else None


class RunLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)
