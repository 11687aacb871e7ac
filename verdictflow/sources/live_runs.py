"""Live runs of the verifier: one process for each job, inside Spark's tasks, each outcome recorded once.

A task asks the shared folder first whether a job's outcome is there already, so that a task that is tried again, or a
second run over the same jobs, starts only what nobody has finished. An outcome is written under a name of the attempt's
own and then renamed, so a half-written one is never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import signal
import subprocess
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verifier import INCONCLUSIVE, SKIPPED, TIMEOUT, function_status, module_status

DONE, LATE, ABSENT = "done", "timeout", "absent"
OUTCOME = "outcome string, stdout string, stderr string, returncode int, seconds double"
SOURCE = "{source}"


def run_command(command: list[str], timeout: float) -> dict:
    """One process in a group of its own; after `timeout` seconds the whole group is killed, and what it has written by then is left out."""
    none = {"stdout": None, "stderr": None, "returncode": None}
    if not command or shutil.which(command[0]) is None:
        return {"outcome": ABSENT, **none, "seconds": 0.0}
    began = time.monotonic()
    child = subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, errors="replace", start_new_session=True)
    try:
        out, err = child.communicate(timeout=timeout)
    except subprocess.TimeoutExpired:
        os.killpg(child.pid, signal.SIGKILL)
        child.communicate()
        return {"outcome": LATE, **none, "seconds": float(timeout)}
    return {"outcome": DONE, "stdout": out, "stderr": err, "returncode": child.returncode, "seconds": round(time.monotonic() - began, 3)}


def job_key(command: list[str], text: str | None) -> str:
    """A job is its command and the source that it reads."""
    return hashlib.sha256(json.dumps([command, text]).encode()).hexdigest()


def _run_with_source(command: list[str], text: str | None, timeout: float) -> dict:
    """The command, with SOURCE in it standing for a file that holds the text; the file is gone when the process is."""
    if text is None:
        return run_command(command, timeout)
    with tempfile.TemporaryDirectory(prefix="verdictflow-job-") as folder:
        path = os.path.join(folder, "unit.py")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return run_command([path if c == SOURCE else c for c in command], timeout)


class Outcomes:
    """Recorded outcomes by job key, in a folder of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri)

    def _path(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str) -> dict | None:
        from pyarrow import fs

        if self.fs.get_file_info(self._path(key)).type == fs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(self._path(key)) as f:
            return json.loads(f.read().decode())

    def put(self, key: str, outcome: dict) -> dict:
        """What is recorded in the end: of two attempts that ran at once, the first one's outcome."""
        own = f"{self.root}/{key[:2]}/.{key}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/{key[:2]}", recursive=True)
        with self.fs.open_output_stream(own) as f:
            f.write(json.dumps(outcome).encode())
        if known := self.get(key):
            self.fs.delete_file(own)
            return known
        self.fs.move(own, self._path(key))
        return outcome


def run_jobs(jobs: DataFrame, outcomes: str, timeout: float = 30, parts: int | None = None) -> DataFrame:
    """jobs (command, and text if the command reads SOURCE) with the columns of OUTCOME; `outcomes` is a folder all executors share.

    A task runs one process at a time, so a cluster runs as many as it has slots. A null command or an unknown
    program is `absent`. Jobs are dealt out evenly, whatever their file; equal jobs that meet in one task run once.
    """
    import pyarrow as pa

    spark, has_text = jobs.sparkSession, "text" in jobs.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [f.split() for f in OUTCOME.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recorded = Outcomes(outcomes)
        for b in batches:
            texts = b["text"].to_pylist() if has_text else [None] * b.num_rows
            for i, (command, text) in enumerate(zip(b["command"].to_pylist(), texts)):
                command = command or []
                key = job_key(command, text)
                got = recorded.get(key) or recorded.put(key, _run_with_source(command, text, timeout))
                row = b.slice(i, 1)
                for name, kind in fields:
                    row = row.append_column(name, pa.array([got[name]], kinds[kind]))
                yield row

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema], OUTCOME])
    by = F.xxhash64("command", *(["text"] if has_text else []))
    return jobs.repartition(parts, by).mapInArrow(run, schema)


def output() -> Column:
    """Both streams as one text, null if there was no run."""
    return F.when(F.col("outcome") == DONE, F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit(""))))


def run_status(whole_file: bool = False) -> Column:
    """Status of a live run; a late run of a function is inconclusive, that of a whole file has a status of its own."""
    judged = module_status(output(), F.col("returncode")) if whole_file else function_status(output(), F.col("returncode"))
    return F.when(F.col("outcome") == ABSENT, SKIPPED).when(F.col("outcome") == LATE, TIMEOUT if whole_file else INCONCLUSIVE).otherwise(judged)
