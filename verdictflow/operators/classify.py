"""Final classes of findings, and roll-ups to files and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verifier import NO_VIOLATION, SKIPPED, VIOLATION

# The classes that decide a file's class, worst first; a file with none of them is clean.
PRIORITY = ("llm_confirmed_by_esbmc", "esbmc_native_bug", "llm_missed_esbmc_bug", "llm_false_positive", "not_confirmed_within_bound", "esbmc_inconclusive", "out_of_scope_finding", "heuristic_smell_only", "skipped_not_verifiable")


def final_class(finding_type: Column, status: Column, matches: Column, direct: Column, llm_only: Column) -> Column:
    """status: of the finding's own run, null without one; direct: of the file's run."""
    none = status.isNull() | (status == SKIPPED)
    bug = F.when(llm_only, "llm_only_suspected").when(none & (direct == VIOLATION), "esbmc_native_bug").when(none, "skipped_not_verifiable").when((status == VIOLATION) & matches, "llm_confirmed_by_esbmc").when(status == VIOLATION, "esbmc_inconclusive").when(status == NO_VIOLATION, "not_confirmed_within_bound").otherwise("esbmc_inconclusive")
    return F.when(finding_type == "out_of_scope_finding", "out_of_scope_finding").when(finding_type == "llm_false_positive", "llm_false_positive").when(finding_type == "smell_heuristic", "heuristic_smell_only").when(finding_type == "suspected_bug", bug).otherwise("skipped_not_verifiable")


def interpretation(final: Column, category: Column, expression: Column | None = None, confidence: Column | None = None, detail: Column | None = None) -> Column:
    """A sentence on a finding's class; detail is the verifier's summary."""
    none = F.lit(None).cast("string")
    expression, confidence, detail = (none if c is None else c for c in (expression, confidence, detail))
    what = F.concat(category, F.when(F.coalesce(expression, F.lit("")) != "", F.concat(F.lit(" ("), expression, F.lit(")"))).otherwise(""))
    told = F.coalesce(detail, F.lit("no details"))
    rows = {
        "out_of_scope_finding": (F.concat(category, F.lit(" is not examined")),),
        "heuristic_smell_only": (F.lit("an opinion about "), category, F.lit(", confidence "), F.coalesce(confidence, F.lit("unknown"))),
        "llm_false_positive": (F.lit("the source has no place for "), what),
        "skipped_not_verifiable": (what, F.lit(" was not verified")),
        "llm_only_suspected": (what, F.lit(" is suspected; nobody has verified it")),
        "llm_confirmed_by_esbmc": (F.lit("the verifier reached the suspected "), what),
        "not_confirmed_within_bound": (F.lit("the verifier found no "), what, F.lit(" within the bound")),
        "esbmc_native_bug": (F.lit("the verifier found "), what, F.lit(" by itself: "), told),
        "llm_missed_esbmc_bug": (F.lit("only the verifier found "), what, F.lit(": "), told),
    }
    out = F.when(final == "clean", told)
    for name, parts in rows.items():
        out = out.when(final == name, F.concat(*parts))
    return out.otherwise(F.concat(F.lit("the verifier neither confirms nor refutes "), what, F.lit(": "), told))


def _synthetic(rows: DataFrame, finding_type: str, category: str, final: str, verifiable: bool) -> DataFrame:
    fixed = {"stage": "esbmc_direct", "finding_type": finding_type, "category": category, "confidence": "high", "final_class": final}
    return rows.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"verifiable": F.lit(verifiable)})


def missed_bugs(native: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows for bugs that the verifier alone has found."""
    return _synthetic(native.join(found.select(*keys).distinct(), keys, "left_anti"), "suspected_bug", "esbmc_detected", "llm_missed_esbmc_bug", True)


def direct_observations(native: DataFrame) -> DataFrame:
    """Rows that keep the verifier's own result of a file in its report."""
    return _synthetic(native, "direct_observation", "esbmc_direct", "clean", False)


def file_class(files: DataFrame, rows: DataFrame, key: str = "file") -> DataFrame:
    """key, file_class: the worst class of a file, clean without any."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("final_class"))
    worst = rows.withColumn("_r", rank).where("_r > 0").groupBy(key).agg(F.min("_r").alias("_r"))
    name = F.try_element_at(F.array(*[F.lit(p) for p in PRIORITY]), F.col("_r").cast("int"))
    return files.join(worst, key, "left").select(key, F.when(F.col("_r").isNull(), "clean").otherwise(name).alias("file_class"))


def first_direct(rows: DataFrame, direct: str = "direct", order: str = "ord", key: str = "file") -> DataFrame:
    """key, direct: the first direct result of a file, in the order of its rows, that is not null."""
    return rows.where(F.col(direct).isNotNull()).groupBy(key).agg(F.min_by(direct, order).alias(direct))


def summary_block(files: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: counts over files (direct_status, function_count) and over analyzer findings (stage, final_class)."""
    llm = rows.where("stage <> 'esbmc_direct'")
    n = lambda *names: F.count_if(F.col("final_class").isin(*names))
    found = llm.agg(
        F.count("*").alias("total_llm_findings"), n("llm_confirmed_by_esbmc").alias("total_confirmed_by_esbmc"), n("llm_false_positive").alias("total_llm_false_positives"), n("heuristic_smell_only").alias("total_smells"),
        n("out_of_scope_finding").alias("total_out_of_scope_findings"), n("esbmc_inconclusive", "not_confirmed_within_bound", "skipped_not_verifiable").alias("total_inconclusive"),
    )
    per = files.agg(F.count("*").alias("total_files"), F.count_if(F.col("direct_status") == VIOLATION).alias("total_esbmc_direct_violations"), F.count_if(F.col("function_count") == 0).alias("total_no_vcc_generated"))
    return per.join(F.broadcast(found))  # one row each


def validation(finding_type: Column, has_guard: Column | None = None, ast_unrecognized: Column | None = None) -> Column:
    """struct(valid, reason, has_guard, ast_unrecognized) of the check against the source; the flags are 'true', 'false' or null."""
    no = F.lit(False)
    flag = lambda c: no if c is None else F.coalesce(c == "true", no)
    guarded, odd = flag(has_guard), flag(ast_unrecognized)
    none = F.lit(None).cast("boolean")
    row = lambda ok, why, guard=no, unknown=none: F.struct(F.lit(ok).alias("valid"), (F.lit(why) if isinstance(why, str) else why).alias("reason"), guard.alias("has_guard"), unknown.alias("ast_unrecognized"))
    why = F.when(odd, "an expression of the source, of another kind than expected").when(guarded, "an operation of the source, behind a guard").otherwise("an operation of the source")
    return (
        F.when(finding_type == "suspected_bug", row(True, why, guarded, odd))
        .when(finding_type == "llm_false_positive", row(False, "not in the source"))
        .when(finding_type == "smell_heuristic", row(True, "an opinion, not checked"))
        .when(finding_type == "out_of_scope_finding", row(False, "category not examined"))
        .otherwise(row(False, F.concat(F.lit("unknown type: "), F.coalesce(finding_type, F.lit("")))))
    )


def strategy(finding_type: Column, verified: Column) -> Column:
    """How a finding was checked; verified: whether it has a verifier run, a skipped one included."""
    return F.when(verified, "esbmc").when(finding_type == "smell_heuristic", "heuristic").otherwise("skipped")


def report_rows(rows: DataFrame, model: str = "") -> DataFrame:
    """Flat report rows of classified findings.

    rows: file, pos, stage, function, category, original_category, finding_type, line, expression, confidence,
    explanation, evidence, verifiable, expected_exception, has_guard, ast_unrecognized, final_class,
    interpretation, and run (struct of the verifier's run, or null).
    """
    outside = F.col("final_class") == "out_of_scope_finding"
    return rows.select(
        "file", "pos", "stage", F.lit(model or "unknown").alias("model"), "function", "category", F.coalesce("original_category", "category").alias("original_category"), (~outside).alias("mvp_scope"),
        F.when(outside, "category_outside_mvp").otherwise("").alias("discard_reason"), F.col("finding_type").alias("type"), F.coalesce(F.col("line").cast("string").try_cast("int"), F.lit(0)).alias("line"), "expression", "confidence",
        F.col("explanation").alias("reasoning"), "evidence", "verifiable", strategy(F.col("finding_type"), F.col("run").isNotNull()).alias("validation_strategy"), "expected_exception",
        validation(F.col("finding_type"), F.col("has_guard"), F.col("ast_unrecognized")).alias("ast_validation"), F.col("run").alias("esbmc_function"), F.col("final_class").alias("final_classification"), "interpretation",
    )


def full_report(files: DataFrame, rows: DataFrame, direct: DataFrame | None = None, expected: DataFrame | None = None, order: str = "ord", key: str = "file") -> DataFrame:
    """One nested row for each file, files without findings too: findings by pos, the direct result, what was expected, the file's class.

    rows: key, pos, stage, final_class and any other columns; direct: key, direct; expected: key and its columns.
    A file's findings are one list, as the report is nested; all roll-ups above work on flat rows instead.
    """
    names = [c for c in rows.columns if c not in (key, "pos")]
    nested = rows.where("stage <> 'esbmc_direct'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("findings"))
    out = files.join(nested, key, "left").withColumn("findings", F.coalesce("findings", F.array()))
    out = out.join(file_class(files, rows, key).withColumnRenamed("file_class", "final_file_classification"), key)
    if direct is not None:
        out = out.join(direct, key, "left")
    if expected is not None:
        wanted = [c for c in expected.columns if c != key]
        out = out.join(expected.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*wanted))).alias("ground_truth_findings")), key, "left").withColumn("ground_truth_findings", F.coalesce("ground_truth_findings", F.array()))
    return out.orderBy(order)


def ground_truth_block(expected: DataFrame | None, path: str | None = None, key: str = "file") -> dict:
    """Totals of the ground truth, or the note that none was given."""
    if expected is None:
        return {"provided": False, "path": path, "evaluation_status": "skipped", "message": "no ground truth was given"}
    n = expected.agg(F.count_distinct(key).alias("files"), F.count("*").alias("items")).first()
    return {"provided": True, "path": path, "total_files": n["files"], "total_expected_findings": n["items"], "evaluation_status": "pending", "message": "given, not evaluated in this report"}


def experiment_block(mode: str, model: str | None, source: str, bound: int, timeout: int, created_at: str) -> dict:
    return {"mode": mode, "created_at": created_at, "input": source, "model": model or "unknown", "bound": bound, "timeout": timeout}
