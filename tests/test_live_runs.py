"""Processes in tasks, and their logs as a data source."""

import os
import sys
import time

import pytest
from pyspark.sql import functions as F

from verdictflow.sources import live_runs
from verdictflow.sources.run_logs import RunLogs, log_name

JOBS = "file string, command array<string>, text string"


def test_outcomes(spark, tmp_path):
    """Output, return code, an unknown program, a null command, a process that outlives its time with a child of its own."""
    late = f"sleep 60 & echo $! > {tmp_path}/child; wait"
    rows = [("ok", ["sh", "-c", "printf 'VERIFICATION SUCCESSFUL'; printf oh >&2"], None), ("bad", ["sh", "-c", "printf 'VERIFICATION FAILED'; exit 3"], None), ("none", ["no-such-verifier"], None), ("null", None, None), ("late", ["sh", "-c", late], None), ("source", ["cat", live_runs.SOURCE], "x = 'é'\n"), ("tool", ["sh", "-c", "printf 'ERROR: x'"], None)]
    began = time.time()
    got = {r.file: r for r in live_runs.run_jobs(spark.createDataFrame(rows, JOBS), str(tmp_path / "o"), timeout=3).select("*", live_runs.run_status().alias("s"), live_runs.run_status(True).alias("w")).collect()}
    assert time.time() - began < 40
    assert (got["ok"].stdout, got["ok"].stderr, got["ok"].returncode, got["ok"].s) == ("VERIFICATION SUCCESSFUL", "oh", 0, "no_violation_found")
    assert (got["bad"].returncode, got["bad"].s) == (3, "violation_found") and got["source"].stdout == "x = 'é'\n" and got["tool"].s == "tool_error"
    assert got["none"].s == got["null"].w == "skipped" and (got["late"].s, got["late"].w, got["late"].stdout) == ("inconclusive", "timeout", None)
    child = (tmp_path / "child").read_text().strip()
    state = open(f"/proc/{child}/stat").read().split()[2] if os.path.exists(f"/proc/{child}") else "gone"
    assert state in ("Z", "X", "gone")


def test_no_job_runs_twice(spark, tmp_path):
    """Each process leaves a mark. Actions repeat the whole plan, and equal jobs are given many times over."""
    mark = lambda i: ["sh", "-c", f"echo x >> {tmp_path}/mark{i}; printf {i}"]
    jobs = spark.createDataFrame([(f"f{i % 5}", mark(i % 5), None) for i in range(200)], JOBS)
    out = live_runs.run_jobs(jobs, str(tmp_path / "o"), parts=4)
    assert out.count() == 200 and {(r.file, r.stdout) for r in out.select("file", "stdout").distinct().collect()} == {(f"f{i}", str(i)) for i in range(5)}
    assert all((tmp_path / f"mark{i}").read_text() == "x\n" for i in range(5))
    assert not [n for _, _, names in os.walk(tmp_path / "o") for n in names if n.startswith(".")]
    assert live_runs.run_jobs(jobs.limit(0), str(tmp_path / "o")).count() == 0


def test_recorded_outcomes_count(spark, tmp_path):
    """What an attempt recorded before it was lost is read, not done again; a later outcome of the same job does not replace it."""
    first = ["sh", "-c", f"echo x >> {tmp_path}/first; printf 1"]
    path = str(tmp_path / "o")
    assert live_runs.Outcomes(path).put(live_runs.job_key(first, None), live_runs.run_command(first, 5))["stdout"] == "1"
    again = live_runs.run_jobs(spark.createDataFrame([("a", first, None)], JOBS), path).first()
    assert again.stdout == "1" and (tmp_path / "first").read_text() == "x\n"
    other = live_runs.Outcomes(path).put(live_runs.job_key(first, None), {"outcome": "done", "stdout": "2"})
    assert other["stdout"] == "1"  # of two attempts, the first one's outcome stays


def test_logs(spark, tmp_path):
    spark.dataSource.register(RunLogs)
    path = str(tmp_path / "logs")
    rows = [("p/a.py", "f", "B1", "one\ntwo"), ("q/a.py", "f", "B1", ""), ("p/a.py", None, None, "é\r\n"), ("p/a.py", "f", "B2", None), (None, None, None, "x")]
    df = spark.createDataFrame(rows, "file string, function string, finding string, log string")
    df.repartition(3).write.format("run_logs").option("path", path).mode("append").save()
    read = lambda: spark.read.format("run_logs").option("path", path).load()
    assert sorted(map(tuple, read().collect()), key=str) == sorted(rows, key=str)
    names = [n for _, _, found in os.walk(path) for n in found]
    assert len(names) == 5 and sum(n.startswith("a_f_B1.") for n in names) == 2 and any(n.startswith("a_direct.") for n in names)
    df.limit(1).write.format("run_logs").option("path", path).mode("overwrite").save()
    assert read().count() == 1
    assert log_name("a.py", "b_c", None) != log_name("a_b.py", "c", None)


def test_failed_jobs_leave_no_log(spark, tmp_path):
    spark.dataSource.register(RunLogs)
    path = str(tmp_path / "logs")
    df = spark.range(50).select(F.col("id").cast("string").alias("file"), F.lit("f").alias("function"), F.lit("").alias("finding"), F.when(F.col("id") == 40, F.raise_error(F.lit("lost"))).otherwise("x").alias("log"))
    with pytest.raises(Exception):
        df.write.format("run_logs").option("path", path).mode("append").save()
    assert [n for _, _, found in os.walk(path) for n in found] == []


def test_python_is_a_program(tmp_path):
    assert live_runs.run_command([sys.executable, "-c", "print(1)"], 20)["stdout"] == "1\n"
