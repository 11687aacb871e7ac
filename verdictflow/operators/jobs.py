"""Verification jobs: planning, deduplication, and roll-up of recorded runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.verifier import FORMAL, VIOLATION, file_status

# The verifier's command line.
BASE_COMMAND, PARAMETER_FLAG = "esbmc", "--assign-param-nondet"


def command(file: Column, function: Column, bound: int = 5, base: str = BASE_COMMAND) -> Column:
    """All categories take the same flag, so one run serves the hybrid flow and the baseline."""
    return F.array(F.lit(base), F.lit("--function"), function, F.lit("--unwind"), F.lit(str(bound)), F.lit(PARAMETER_FLAG), file)


def plan_jobs(findings: DataFrame, functions: DataFrame, bound: int = 5) -> DataFrame:
    """Distinct (file, function) of verifiable findings and of all functions, with the command of each."""
    both = findings.where("verifiable").select("file", "function").unionByName(functions.select("file", "function"))
    return both.dropDuplicates(["file", "function"]).withColumn("command", command(F.col("file"), F.col("function"), bound))


def distinct_functions(units: DataFrame) -> DataFrame:
    """The first of each function name of a file, in order."""
    first = F.row_number().over(Window.partitionBy("file", "function").orderBy("ord"))
    return units.withColumn("_n", first).where("_n = 1").drop("_n")


def replay(jobs: DataFrame, recorded: DataFrame) -> DataFrame:
    """Jobs with their recorded output; jobs without one have null output, which counts as skipped."""
    return jobs.join(recorded, ["file", "function"], "left")


def file_rollup(files: DataFrame, runs: DataFrame, key: str = "file") -> DataFrame:
    """key, status, functions, violating (sorted by ord); files without functions were skipped."""
    bad = F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == VIOLATION, F.struct("ord", "function")))), lambda x: x["function"])
    per = runs.groupBy(key).agg(file_status(F.col("status")).alias("status"), F.count("*").alias("functions"), bad.alias("violating"))
    out = files.join(per, key, "left")
    return out.select(key, F.coalesce("status", F.lit("skipped")).alias("status"), F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("violating", F.array().cast("array<string>")).alias("violating"))


def sweep_tally(rows: DataFrame, expected: str = "category") -> DataFrame:
    """category, ok, fail, skip, total: whether runs end as their category wants.

    rows: category, function (null where the file has none) and sweep_status(). Bugs should fail verification,
    anything else should pass it.
    """
    want = F.when(F.col(expected).isin(*FORMAL), "FAILED").otherwise("SUCCESSFUL")
    none = F.col("function").isNull()
    return rows.groupBy(expected).agg(F.count_if(~none & (F.col("sweep_status") == want)).alias("ok"), F.count_if(~none & (F.col("sweep_status") != want)).alias("fail"), F.count_if(none).alias("skip"), F.count("*").alias("total"))
