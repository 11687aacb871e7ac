"""Queries of verifier output, jobs and roll-ups, over runs made from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verifier as V
from ..operators import jobs, lineage
from ..sources import live_runs
from ..sources.run_logs import RunLogs
from . import fixtures as X


def _runs(spark, d):
    return X.bound(spark, d, X.RUNS)


def verifier_status(spark, d):
    return _runs(spark, d).select("event_id", V.function_status(F.col("stdout"), F.col("returncode")).alias("status"))


def direct_status(spark, d):
    return _runs(spark, d).select("event_id", V.module_status(F.col("stdout"), F.col("returncode"), F.col("event_id") % 50 == 0).alias("status"))


def vcc(spark, d):
    return _runs(spark, d).select("event_id", V.vcc_count(F.col("stdout")).cast("long").alias("vcc"))


def details_parse(spark, d):
    return _runs(spark, d).select("event_id", V.property_parts(F.col("stdout")).alias("p")).select("event_id", "p.kind", "p.text", "p.function", F.col("p.line").cast("long").alias("line"))


def property_category(spark, d):
    p = V.property_parts(F.col("stdout"))
    return _runs(spark, d).select("event_id", V.property_category(F.concat_ws(" ", p["kind"], p["text"])).alias("category"))


def category_match(spark, d):
    p = V.property_parts(F.col("stdout"))
    rows = _runs(spark, d).select("event_id", V.matches_category(p["kind"], p["text"], F.lit("out_of_bounds")).alias("m"))
    return rows.groupBy("m").agg(F.count("*").alias("n"))


def counterexample_top6(spark, d):
    return _runs(spark, d).select("event_id", F.array_join(V.counterexample(F.col("stdout")), ";").alias("values"), F.array_join(V.warnings(F.col("stdout")), ";").alias("warnings"))


def summaries(spark, d):
    p = V.property_parts(F.col("stdout"))
    return _runs(spark, d).groupBy(V.summary(V.function_status(F.col("stdout"), F.col("returncode")), p["kind"], p["text"]).alias("summary")).agg(F.count("*").alias("n"))


def baseline_rollup(spark, d):
    """Every third run has output; the others were skipped."""
    runs = _runs(spark, d).withColumn("stdout", F.when(F.col("event_id") % 3 == 0, F.col("stdout")))
    runs = runs.withColumn("status", V.function_status(F.col("stdout"), F.col("returncode")))
    files = _runs(spark, d).select("file").distinct()
    out = jobs.file_rollup(files, runs).select("file", "status", F.col("functions").cast("long").alias("functions"), "violating")
    return out.select("file", "status", "functions", F.array_join("violating", ",").alias("violating"), F.md5(V.baseline_summary(F.col("status"), F.col("functions"), F.col("violating"))).alias("summary"))


def job_dedup(spark, d):
    runs = _runs(spark, d)
    findings = runs.withColumn("verifiable", F.col("event_id") % 2 == 0)
    units = runs.select("file", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("function"))
    return jobs.plan_jobs(findings, units).select("file", "function", F.array_join("command", " ").alias("command"))


def first_functions(spark, d):
    return jobs.distinct_functions(_runs(spark, d)).select("file", "function", "ord")


def replayed(spark, d):
    """Every fourth run was recorded; a function without a recording was skipped."""
    told = lambda c: F.max(F.when(F.col("event_id") % 4 == 0, F.col(c))).alias(c)
    runs = _runs(spark, d).groupBy("file", "function").agg(told("stdout"), told("returncode"))
    plan = _runs(spark, d).select("file", "function").distinct()
    return jobs.replay(plan, runs).select("file", "function", V.function_status(F.col("stdout"), F.col("returncode")).alias("status"))


def _swept(spark, d):
    late = F.col("event_id") % 60 == 0
    out = F.when(~late, F.col("stdout")).otherwise("")
    return _runs(spark, d).withColumn("sweep_status", V.sweep_status(out, late)).withColumn("keyword", V.keyword(out, F.col("sweep_status")))


def sweep_keywords(spark, d):
    return _swept(spark, d).groupBy("sweep_status", "keyword").agg(F.count("*").alias("n"))


def sweep_tally(spark, d):
    category = F.when(F.col("event_id") % 4 == 0, "clean").when(F.col("event_id") % 4 == 1, "division_by_zero").when(F.col("event_id") % 4 == 2, "out_of_bounds").otherwise("assertion_violation")
    rows = _swept(spark, d).withColumn("category", category).withColumn("function", F.when(F.col("event_id") % 9 != 0, F.col("function")))
    return jobs.sweep_tally(rows)


def pretty(spark, d):
    out = F.col("stdout")
    p = V.property_parts(out)
    place = V.location(p["function"], p["line"])
    status = V.function_status(out, F.col("returncode"))
    text = V.pretty(status, p["kind"], p["text"], place, V.counterexample(out), V.warnings(out), F.concat("file", F.lit(".log")))
    return _runs(spark, d).select("event_id", F.md5(text).alias("pretty"), V.module_summary(V.module_status(out, F.col("returncode")), p["kind"], place).alias("summary"))


_BASIC = "CASE WHEN lower(stdout) LIKE '%verification failed%' THEN 'violation_found' WHEN lower(stdout) LIKE '%verification successful%' OR returncode = 0 THEN 'no_violation_found' ELSE 'inconclusive' END"
_TOOL = "contains(stdout, 'ERROR:') AND NOT contains(stdout, 'VERIFICATION')"
_STATUS = f"CASE WHEN stdout IS NULL THEN 'skipped' WHEN {_TOOL} THEN 'tool_error' ELSE {_BASIC} END"
_VCC = "TRY_CAST(nullif(regexp_extract(stdout, '(?i)Generated\\s+(\\d+)\\s+VCC', 1), '') AS BIGINT)"

def live_runs_of_units(spark, d):
    """Every unit's verifier is a shell that prints what the table says; where that says nothing, the program does not exist."""
    said = F.array(*map(F.lit, ("sh", "-c", 'printf "%s" "$1"; exit "$2"', "run")), F.col("stdout"), F.col("returncode").cast("string"))
    jobs_ = X.bound(spark, d, X.UNIT_RUNS).select("file", "function", F.when(F.col("stdout").isNull(), F.array(F.lit("no-such-verifier"))).otherwise(said).alias("command"))
    return live_runs.run_jobs(jobs_, lineage.shared_folder(spark, "outcomes"))


def live_status(spark, d):
    return live_runs_of_units(spark, d).select("file", "function", "outcome", "returncode", F.length("stdout").alias("n_chars"), live_runs.run_status().alias("status"), live_runs.run_status(True).alias("whole_status"))


def run_logs(spark, d):
    """Logs of all recorded runs, written as files and read back."""
    spark.dataSource.register(RunLogs)
    folder = lineage.shared_folder(spark, "logs")
    rows = X.bound(spark, d, X.UNIT_RUNS).select("file", "function", F.lit("B1").alias("finding"), F.col("stdout").alias("log"))
    rows.write.format("run_logs").option("path", folder).mode("append").save()
    return spark.read.format("run_logs").option("path", folder).load().select("file", "function", "finding", F.md5("log").alias("digest"))


_R = f"runs AS ({X.RUNS})"
# In these runs a place stands before the property's kind and text, but for every third run, which has its place from the state.
_BODY = "string_split(regexp_extract(stdout, '(?s)Violated property:\\n(.*)\\n\\nVERIFICATION FAILED', 1), chr(10))"
_PARTS = f"parts AS (SELECT event_id, returncode, stdout, {_STATUS} AS status, nullif(trim(coalesce({_BODY}[CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END], '')), '') AS kind, nullif(trim(coalesce({_BODY}[CASE WHEN event_id % 3 = 0 THEN 2 ELSE 3 END], '')), '') AS text, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'f' || CAST(event_id % 7 AS VARCHAR) ELSE 'h' || CAST(event_id % 5 AS VARCHAR) END END AS function, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN event_id % 90 ELSE event_id % 80 END END AS line, file FROM (SELECT runs.*, event_type FROM runs JOIN events USING (event_id)))"
_CAT = "CASE WHEN contains(p, 'assertion') THEN 'assertion_violation' WHEN contains(p, 'division by zero') THEN 'division_by_zero' WHEN contains(p, 'bounds') OR contains(p, 'dereference') OR contains(p, 'indexerror') THEN 'out_of_bounds' ELSE 'unknown_esbmc_violation' END"
_MODULE = f"CASE WHEN {_TOOL} THEN CASE WHEN contains(stdout, 'Cannot open file') OR contains(lower(stdout), 'not supported') THEN 'unsupported_case' ELSE 'tool_error' END WHEN ({_BASIC}) = 'no_violation_found' AND {_VCC} = 0 THEN 'no_vcc_generated' ELSE {_BASIC} END"
# In these runs an error line is the whole output.
_SWEPT = f"""{_R}, late AS (SELECT event_id, event_id % 60 = 0 AS late, CASE WHEN event_id % 60 = 0 THEN '' ELSE stdout END AS stdout FROM runs),
verdict AS (SELECT *, CASE WHEN late THEN 'timeout' WHEN contains(stdout, 'VERIFICATION FAILED') THEN 'FAILED' WHEN contains(stdout, 'VERIFICATION SUCCESSFUL') THEN 'SUCCESSFUL' ELSE 'inconclusive' END AS sweep_status FROM late),
swept AS (SELECT event_id, sweep_status, CASE WHEN contains(lower(stdout), 'dereference failure') THEN 'dereference' WHEN contains(lower(stdout), 'division by zero') THEN 'div-by-zero' WHEN contains(lower(stdout), 'assertion') AND sweep_status = 'FAILED' THEN 'assertion' WHEN sweep_status = 'inconclusive' THEN substr(stdout, 1, 30) ELSE '' END AS keyword FROM verdict)"""

_LIVE = "CASE WHEN stdout IS NULL THEN 'skipped' WHEN contains(stdout, 'FAILED') THEN 'violation_found' WHEN contains(stdout, 'SUCCESSFUL') THEN 'no_violation_found' ELSE 'tool_error' END"

PLANS = {
    "q_live_runs": (live_status, f"SELECT file, function, CASE WHEN stdout IS NULL THEN 'absent' ELSE 'done' END AS outcome, CASE WHEN stdout IS NOT NULL THEN returncode END AS returncode, length(stdout) AS n_chars, {_LIVE} AS status, {_LIVE} AS whole_status FROM ({X.UNIT_RUNS}) r"),
    "q_run_logs": (run_logs, f"SELECT file, function, 'B1' AS finding, md5(stdout) AS digest FROM ({X.UNIT_RUNS}) r"),
    "q_verifier_status": (verifier_status, f"WITH {_R} SELECT event_id, {_STATUS} AS status FROM runs"),
    "q_direct_status": (direct_status, f"WITH {_R} SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'timeout' WHEN {_TOOL} THEN CASE WHEN contains(stdout, 'Cannot open file') OR contains(lower(stdout), 'not supported') THEN 'unsupported_case' ELSE 'tool_error' END WHEN ({_BASIC}) = 'no_violation_found' AND {_VCC} = 0 THEN 'no_vcc_generated' ELSE {_BASIC} END AS status FROM runs"),
    "q_vcc": (vcc, f"WITH {_R} SELECT event_id, {_VCC} AS vcc FROM runs"),
    "q_details_parse": (details_parse, f"WITH {_R}, {_PARTS} SELECT event_id, kind, text, function, line FROM parts"),
    "q_property_category": (property_category, f"WITH {_R}, {_PARTS} SELECT event_id, {_CAT.replace('(p,', '(lower(concat_ws(chr(32), kind, text)),')} AS category FROM parts"),
    "q_category_match": (category_match, f"WITH {_R}, {_PARTS} SELECT ({_CAT.replace('(p,', '(lower(concat_ws(chr(32), kind, text)),')}) = 'out_of_bounds' AS m, count(*) AS n FROM parts GROUP BY 1"),
    "q_counterexample_top6": (counterexample_top6, f"WITH {_R} SELECT event_id, CASE WHEN contains(stdout, 'Violated') THEN 'x = ' || CAST(event_id AS VARCHAR) || ';y = 2;a = 1;b = 2;c = 3;d = 4' ELSE '' END AS \"values\", CASE WHEN contains(stdout, 'SyntaxWarning:') THEN 'odd literal' ELSE '' END AS warnings FROM runs"),
    "q_summaries": (summaries, f"WITH {_R}, {_PARTS} SELECT CASE status WHEN 'violation_found' THEN 'property violated: ' || kind || ' - ' || text WHEN 'no_violation_found' THEN 'no property violated within the bound' WHEN 'tool_error' THEN 'the verifier failed' WHEN 'skipped' THEN 'not run' ELSE 'no verdict' END AS summary, count(*) AS n FROM parts GROUP BY 1"),
    "q_baseline_rollup": (baseline_rollup, f"WITH {_R}, s AS (SELECT file, function, event_id, {_STATUS} AS status FROM (SELECT event_id, file, function, returncode, CASE WHEN event_id % 3 = 0 THEN stdout END AS stdout FROM runs)), g AS (SELECT file, count(*) AS n, CASE WHEN bool_or(status = 'violation_found') THEN 'violation_found' WHEN bool_and(status = 'skipped') THEN 'skipped' WHEN bool_or(status = 'no_violation_found') THEN 'no_violation_found' WHEN bool_and(status = 'tool_error') THEN 'tool_error' ELSE 'inconclusive' END AS status, coalesce(string_agg(function, ',' ORDER BY event_id) FILTER (WHERE status = 'violation_found'), '') AS violating FROM s GROUP BY file) SELECT file, status, n AS functions, violating, md5(CASE status WHEN 'violation_found' THEN 'violated in ' || replace(violating, ',', ', ') WHEN 'no_violation_found' THEN CAST(n AS VARCHAR) || ' functions without violation within the bound' WHEN 'skipped' THEN 'not run: no verifier, or no function' WHEN 'tool_error' THEN 'the verifier failed on every function' ELSE 'no verdict' END) AS summary FROM g"),
    "q_job_dedup": (job_dedup, f"WITH {_R}, j AS (SELECT file, function FROM runs WHERE event_id % 2 = 0 UNION SELECT file, 'g' || CAST(event_id % 3 AS VARCHAR) FROM runs) SELECT file, function, 'esbmc --function ' || function || ' --unwind 5 --assign-param-nondet ' || file AS command FROM j"),
    "q_first_functions": (first_functions, f"WITH {_R} SELECT file, function, min(ord) AS ord FROM runs GROUP BY file, function"),
    "q_replay": (replayed, f"WITH {_R}, r AS (SELECT file, function, max(stdout) FILTER (WHERE event_id % 4 = 0) AS stdout, max(returncode) FILTER (WHERE event_id % 4 = 0) AS returncode FROM runs GROUP BY file, function) SELECT file, function, {_STATUS} AS status FROM r"),
    "q_sweep_keywords": (sweep_keywords, f"WITH {_SWEPT} SELECT sweep_status, keyword, count(*) AS n FROM swept GROUP BY 1, 2"),
    "q_sweep_tally": (sweep_tally, f"WITH {_SWEPT}, c AS (SELECT CASE event_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'division_by_zero' WHEN 2 THEN 'out_of_bounds' ELSE 'assertion_violation' END AS category, event_id % 9 = 0 AS none, sweep_status = CASE WHEN event_id % 4 = 0 THEN 'SUCCESSFUL' ELSE 'FAILED' END AS good FROM swept) SELECT category, count(*) FILTER (WHERE good AND NOT none) AS ok, count(*) FILTER (WHERE NOT good AND NOT none) AS fail, count(*) FILTER (WHERE none) AS skip, count(*) AS total FROM c GROUP BY category"),
    "q_pretty": (pretty, f"WITH {_R}, {_PARTS}, m AS (SELECT *, {_MODULE} AS module, concat_ws(', ', function, 'line ' || CAST(line AS VARCHAR)) AS place, contains(stdout, 'SyntaxWarning') AS warned FROM parts) SELECT event_id, md5(concat_ws(chr(10), CASE status WHEN 'violation_found' THEN 'violation confirmed' WHEN 'no_violation_found' THEN 'no violation within the bound' ELSE 'no verdict, or an error' END, 'place: ' || nullif(place, ''), 'property kind: ' || kind, 'property: ' || text, CASE WHEN kind IS NOT NULL THEN concat_ws(chr(10) || '- ', 'counterexample:', 'x = ' || CAST(event_id AS VARCHAR), 'y = 2', 'a = 1', 'b = 2', 'c = 3', 'd = 4') END, CASE WHEN warned THEN 'warnings:' || chr(10) || '- odd literal' END, 'full log: ' || file || '.log')) AS pretty, CASE module WHEN 'violation_found' THEN 'property violated: ' || kind || ' at ' || place WHEN 'no_violation_found' THEN 'no property violated within the bound' WHEN 'no_vcc_generated' THEN 'no verification conditions: nothing to check at module level' WHEN 'tool_error' THEN 'the verifier failed' WHEN 'unsupported_case' THEN 'the file is not supported' ELSE 'no verdict' END AS summary FROM m"),
}
