"""The three flows in one piece each, and the benchmark that holds all of them against ground truth.

units: extract_units() with unit_key; responses: (unit_key, response); runs: recorded verifier runs (file, function,
stdout, returncode), one a function. Nothing is called here: analyzer answers and runs are recorded tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verifier as V
from . import attempts, classify, evaluation, jobs, lineage, normalize


def keyed_units(units: DataFrame) -> DataFrame:
    """units with unit_key: the file and the place of the unit in it."""
    return units.withColumn("unit_key", F.concat_ws("::", "path", F.col("ord").cast("string"), "qualname"))


def read_runs(runs: DataFrame) -> DataFrame:
    """runs with status and the parts of the violated property; a run without output was skipped."""
    out = F.col("stdout")
    return runs.withColumn("status", V.function_status(out, F.col("returncode"))).withColumn("_p", V.property_parts(out)).select(*runs.columns, "status", F.col("_p.kind").alias("property_kind"), F.col("_p.text").alias("property_text"), V.location(F.col("_p.function"), F.col("_p.line")).alias("location"), V.counterexample(out).alias("counterexample"))


def _with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    own = read_runs(runs).drop("stdout", "stderr")
    out = rows.join(own, ["file", "function"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit(V.SKIPPED)))


def verifier_only(files: DataFrame, units: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flow A: (functions, files). Each distinct function of a file once; the file's status follows from them."""
    each = jobs.distinct_functions(units.select(F.col("path").alias("file"), F.col("name").alias("function"), "ord"))
    functions = _with_runs(each, runs).withColumn("summary", V.summary(F.col("status"), F.col("property_kind"), F.col("property_text"), F.col("location")))
    rolled = jobs.file_rollup(files.select("file"), functions)
    return functions, rolled.withColumn("summary", V.baseline_summary(F.col("status"), F.col("functions"), F.col("violating")))


def hybrid(units: DataFrame, responses: DataFrame, runs: DataFrame) -> DataFrame:
    """Flow B: normalized findings; the verifiable ones with their function's run; each with its final class."""
    found = normalize.analyzed(units, responses).withColumnRenamed("path", "file")
    own = _with_runs(found.where("verifiable"), runs)
    checked = own.withColumn("property", V.property_category(F.concat_ws(" ", F.coalesce("property_kind", F.lit("")), F.coalesce("property_text", F.lit("")))))
    out = checked.unionByName(found.where("not verifiable"), allowMissingColumns=True)
    return _classed(out, F.coalesce(F.col("property") == F.col("category"), F.lit(False)), False)


def analyzer_only(units: DataFrame, responses: DataFrame) -> DataFrame:
    """Flow C: normalized findings as they are, suspected bugs unverified."""
    found = normalize.analyzed(units, responses).withColumnRenamed("path", "file").withColumns({c: F.lit(None).cast("string") for c in ("status", "property", "property_kind", "property_text", "location")})
    return _classed(found, F.lit(False), True)


def _classed(rows: DataFrame, matches, llm_only: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    final = classify.final_class(F.col("finding_type"), F.col("status"), matches, none, F.lit(llm_only))
    detail = V.summary(F.col("status"), F.col("property_kind"), F.col("property_text"), F.col("location"))
    out = rows.withColumn("final_class", final)
    return out.withColumn("interpretation", classify.interpretation(F.col("final_class"), F.col("category"), F.col("expression"), F.col("confidence"), F.when(F.col("status").isNotNull(), detail)))


def benchmark(cases: DataFrame, expected: DataFrame, units: DataFrame, answers: DataFrame, runs: DataFrame, tries: int = attempts.TRIES) -> tuple[DataFrame, DataFrame]:
    """(counts of each case, counts of each category) of all three flows against ground truth.

    cases: case_id, file, and status ('ok', 'missing' where the file does not exist, or 'failed' where it is known that
    the analyzer gave up). answers: (unit_key, response), or the answers of several attempts as attempts.placed() wants
    them. Of a file the first attempt without an error counts; a case whose every attempt failed is left out of all
    counts. The units are cut once for all flows. expected: case_id, function, category, verifiable.
    """
    units = lineage.cut(units)
    rows = attempts.placed(units, answers, tries)
    ended = lineage.cut(attempts.outcomes(units, rows))
    given_up = ended.where("attempt is null").select("file")
    tried = cases.where("status <> 'failed'")
    there = tried.where("status = 'ok'").select("case_id", "file").join(given_up, "file", "left_anti")
    findings = hybrid(units, attempts.counted_answers(rows, ended), runs).join(there, "file").select("case_id", "function", "category", "finding_type", "verifiable", "status", "property")
    functions, _ = verifier_only(there.select("file").distinct(), units, runs)
    direct = evaluation.flow_a_findings(functions.join(there, "file"))
    known = expected.join(there.select("case_id"), "case_id", "left_semi")
    lost = tried.where("status = 'missing'").select("case_id")
    absent = evaluation.missing_file_counts(lost, expected.join(lost, "case_id", "left_semi"))
    return evaluation.case_counts(there, known, findings, direct).unionByName(absent), evaluation.category_counts(known, findings)
