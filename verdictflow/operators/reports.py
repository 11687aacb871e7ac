"""Comparison of benchmark reports, annotation rows, and report layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.findings import base_name, fixed, row_key

SECTIONS = ("bugs_llm_only", "bugs_hybrid_pipeline", "smells", "esbmc_direct_baseline")
EMPTY_FILTER = "__empty__"


def section_table(totals: DataFrame, counters: dict[str, tuple[str, str, str]], by: str = "model") -> DataFrame:
    """by, section, precision, recall, f1, tp, fp, fn: one row for each model and section."""
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(a).alias("tp"), F.col(b).alias("fp"), F.col(c).alias("fn")) for s, (a, b, c) in counters.items()]))
    out = totals.select(by, rows.alias("x")).select(by, "x.*")
    return out.select(by, "section", F.round(M.precision("tp", "fp"), 4).alias("precision"), F.round(M.recall("tp", "fn"), 4).alias("recall"), F.round(M.f1("tp", "fp", "fn"), 4).alias("f1"), "tp", "fp", "fn")


def shown_precision(precision: Column, tp: Column, fp: Column) -> Column:
    """As text; N/A if nothing was reported at all."""
    return F.when((tp == 0) & (fp == 0), "N/A").otherwise(fixed(precision))


def section_pivot(table: DataFrame, by: str = "model") -> DataFrame:
    return table.groupBy(by).pivot("section", list(SECTIONS)).agg(F.first("f1"))


def needs_note(table: DataFrame, by: str = "model") -> DataFrame:
    """by, note: whether the model's baseline detected nothing, so that its precision is shown as N/A."""
    return table.groupBy(by).agg(F.coalesce(F.bool_or((F.col("section") == "esbmc_direct_baseline") & (F.col("tp") == 0) & (F.col("fp") == 0)), F.lit(False)).alias("note"))


def hallucination_table(totals: DataFrame, by: str = "model") -> DataFrame:
    """by, count, rate."""
    return totals.select(by, F.col("hallucinations").alias("count"), F.round(M.hallucination_rate("hallucinations", "bug_tp", "bug_fp", "ghosts"), 4).alias("rate"))


def category_table(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, precision, recall, f1, tp, fp, fn of counts of tp, fp, fn."""
    return counts.select(*keys, F.round(M.precision("tp", "fp"), 4).alias("precision"), F.round(M.recall("tp", "fn"), 4).alias("recall"), F.round(M.f1("tp", "fp", "fn"), 4).alias("f1"), "tp", "fp", "fn")


def _section(p: str, f: str | None, *more: Column) -> Column:
    c = lambda x, d="long": F.col(f"{p}_{x}").cast(d)
    parts = [F.round(M.precision(c("tp"), c("fp")), 4).alias("precision"), F.round(M.recall(c("tp"), c("fn")), 4).alias("recall"), F.round(M.f1(c("tp"), c("fp"), c("fn")), 4).alias("f1"), *[c(x).alias(x) for x in ("tp", "fp", "fn")]]
    if f:
        of = [f"{f}_{x}" for x in ("tp", "fp", "fn", "tn")]
        parts += [F.round(M.accuracy(*of), 4).alias("function_accuracy"), F.round(M.mcc(*of), 4).alias("function_mcc"), *[F.col(o).alias(f"function_{o[-2:]}") for o in of]]
    return F.struct(*parts, *more)


def benchmark_report(totals: DataFrame, categories: DataFrame, intervals: DataFrame | None = None, by: str = "model", backend: str = "", prompt_mode: str = "raw", ground_truth: str = "", bound: int = 5, timeout: int = 30) -> DataFrame:
    """by, report: the benchmark report of each model as a nested row, ready for to_json().

    totals: by and COUNTERS; categories: by, flow (llm or hybrid), category, tp, fp, fn; intervals: by, metric, low, high.
    """
    cell = F.struct("precision", "recall", "f1", "tp", "fp", "fn")
    per = category_table(categories, [by, "flow", "category"]).groupBy(by).agg(*[F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("flow") == flow, F.struct("category", cell.alias("m")))))).alias(f"per_category_{flow}") for flow in ("llm", "hybrid")])
    out = totals.join(per, by, "left")
    return _reports(out, intervals, by, backend, prompt_mode, ground_truth, bound, timeout)


def model_reports(counts: DataFrame, intervals: DataFrame | None = None, by: str = "model", backend: str = "", prompt_mode: str = "raw", ground_truth: str = "", bound: int = 5, timeout: int = 30) -> DataFrame:
    """As benchmark_report(), from evaluation.report_counts(): without a join, so that every input is read once."""
    cell = lambda x: F.struct(F.round(M.precision(x["tp"], x["fp"]), 4).alias("precision"), F.round(M.recall(x["tp"], x["fn"]), 4).alias("recall"), F.round(M.f1(x["tp"], x["fp"], x["fn"]), 4).alias("f1"), x["tp"].alias("tp"), x["fp"].alias("fp"), x["fn"].alias("fn"))
    out = counts.withColumns({f"per_category_{flow}": F.map_from_entries(F.transform(flow, lambda x: F.struct(x["category"], cell(x)))) for flow in ("llm", "hybrid")})
    return _reports(out, intervals, by, backend, prompt_mode, ground_truth, bound, timeout)


def _reports(out: DataFrame, intervals: DataFrame | None, by: str, backend: str, prompt_mode: str, ground_truth: str, bound: int, timeout: int) -> DataFrame:
    rate = lambda c: F.round(c, 4)
    proof = [F.col("confirmed").alias("llm_confirmed_by_esbmc"), F.col("not_confirmed").alias("not_confirmed_within_bound"), F.col("inconclusive").alias("esbmc_inconclusive"), rate(M.confirmation_rate("confirmed", "not_confirmed", "inconclusive")).alias("formal_confirmation_rate"), rate(M.noise_reduction("bug_fp", "hybrid_fp")).alias("noise_reduction_rate")]
    metrics = F.struct(_section("bug", "func").alias("bugs_llm_only"), _section("hybrid", "hybrid_func", *proof).alias("bugs_hybrid_pipeline"), _section("smell", None).alias("smells"), _section("direct", "direct_func").alias("esbmc_direct_baseline"))
    ci = F.lit(None).cast("map<string,array<double>>")
    if intervals is not None:
        own = intervals.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.array(F.round("low", 4), F.round("high", 4)).alias("v"))))).alias("_ci"))
        out, ci = out.join(own, by, "left"), F.col("_ci")
    noise = F.struct(F.col("hallucinations").alias("count"), rate(M.hallucination_rate("hallucinations", "bug_tp", "bug_fp", "ghosts")).alias("rate"))
    return out.select(by, F.struct(F.col(by).alias("model"), F.lit(backend).alias("backend"), F.lit(prompt_mode).alias("prompt_mode"), F.lit(ground_truth).alias("ground_truth"), F.lit(bound).alias("bound"), F.lit(timeout).alias("timeout"), metrics.alias("metrics"), noise.alias("hallucinations"), F.struct(F.col("out_of_scope").alias("count")).alias("out_of_scope_findings"), "per_category_llm", "per_category_hybrid", ci.alias("confidence_intervals_95")).alias("report"))


def report_format(text: Column) -> Column:
    """Layout of a report by its top-level keys."""
    v = F.trim(text)
    has = lambda k: F.get_json_object(v, f"$.{k}").isNotNull()
    return F.when(F.startswith(v, F.lit("[")), "flat").when(has("files") & has("summary") & has("experiment"), "full").when(has("metrics") & (has("model") | has("backend")), "benchmark").otherwise("unknown")


_FLAT = "array<struct<unit_name:string,source_file:string,final_classification:string,interpretation:string,finding:struct<stage:string,category:string,confidence:string,explanation:string,metadata:struct<expression:string,line:string>>>>"
_FULL = "struct<files:array<struct<file:string,llm_results:array<struct<function:string,category:string,expression:string,line:string,final_classification:string,confidence:string,reasoning:string,interpretation:string>>>>>"
# What a report is called by its three sections, and display classes of final classes.
_SUMMARY = (("LLM bugs F1=", ("$.metrics.bugs_llm_only", "$.metrics.bugs")), ("Hybrid F1=", ("$.metrics.bugs_hybrid_pipeline",)), ("Smells F1=", ("$.metrics.smells",)))
BADGES = {"cls-ok": ("llm_confirmed_by_esbmc", "runtime_reproduced_by_harness"), "cls-bad": ("llm_false_positive", "llm_missed_esbmc_bug"), "cls-mid": ("not_confirmed_within_bound", "esbmc_inconclusive")}


def benchmark_summary(text: Column) -> Column:
    """F1 of the three sections, three digits, - where a section has none."""
    def shown(label: str, paths: tuple[str, ...]) -> Column:
        f1 = F.coalesce(*[F.get_json_object(text, f"{p}.f1") for p in paths]).try_cast("double")
        return F.concat(F.lit(label), F.when(f1.isNotNull(), F.format_string("%.3f", f1)).otherwise("-"))

    return F.concat_ws(" | ", *[shown(*x) for x in _SUMMARY])


def normalized_rows(reports: DataFrame) -> DataFrame:
    """Reports (file, report as JSON) of the three layouts to annotation rows with row_key; unknown layouts give none."""
    kind = report_format(F.col("report"))
    name = F.regexp_replace("file", r"(?i)\.json$", "")
    told = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object("report", p), F.lit("")) for p in paths], name)
    known = reports.select("file", "report", kind.alias("kind")).withColumn("model", F.when(F.col("kind") == "flat", name).otherwise(told("$.experiment.model", "$.model")))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.when(blank("x.line") == "0", "").otherwise(blank("x.line"))
    row = lambda path, function, final, summary: [F.col("model"), F.col("file").alias("report"), path.alias("file"), function.alias("function"), blank("x.category").alias("category"), blank("x.expression").alias("expression"), line.alias("line"), final.alias("final_class"), blank("x.confidence").alias("confidence"), summary.alias("summary")]
    why = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(""))
    files = known.where("kind = 'full'").select("model", "file", F.explode(F.from_json("report", _FULL)["files"]).alias("f"))
    full = files.select("model", "file", F.col("f.file").alias("path"), F.explode("f.llm_results").alias("x")).select(*row(blank("path"), blank("x.function"), blank("x.final_classification"), why("x.reasoning", "x.interpretation")))
    flat = known.where("kind = 'flat'").select("model", "file", F.explode(F.from_json("report", _FLAT)).alias("r")).where("coalesce(r.finding.stage, '') <> 'esbmc_direct'")
    flat = flat.select("model", "file", "r", F.struct("r.finding.category", "r.finding.metadata.expression", "r.finding.metadata.line", "r.finding.confidence").alias("x")).select(*row(blank("r.source_file"), blank("r.unit_name"), blank("r.final_classification"), why("r.finding.explanation")))
    empty = F.lit("")
    bench = known.where("kind = 'benchmark'").select("model", F.col("file").alias("report"), F.lit("(benchmark)").alias("file"), empty.alias("function"), F.lit("metrics").alias("category"), empty.alias("expression"), empty.alias("line"), F.lit("benchmark").alias("final_class"), empty.alias("confidence"), benchmark_summary(F.col("report")).alias("summary"), F.concat_ws("::", F.lit("benchmark"), "model", "file").alias("row_key"))
    found = full.unionByName(flat)
    return found.withColumn("row_key", _key_of_row()).unionByName(bench)


def _key_of_row() -> Column:
    return row_key(F.col("model"), base_name(F.col("file")), F.col("function"), F.col("category"), F.col("line"), F.col("expression"), F.col("final_class"))


def models(rows: DataFrame) -> DataFrame:
    """The distinct models, sorted."""
    return rows.select("model").distinct().orderBy("model")


def badge(final: Column) -> Column:
    """Display class of a final class."""
    out = None
    for name, classes in BADGES.items():
        out = F.when(final.isin(*classes), name) if out is None else out.when(final.isin(*classes), name)
    return out.otherwise("cls-neutral")


def annotation_rows(rows: DataFrame) -> DataFrame:
    """Adds the composite key; rows of the verifier's own stage are left out."""
    return rows.where("stage <> 'esbmc_direct'").withColumn("row_key", _key_of_row())


def _blank_note() -> Column:
    return (F.coalesce("verdict", F.lit("")) == "") & (F.coalesce("note", F.lit("")) == "")


def search(rows: DataFrame, notes: DataFrame, text: str = "", model: str = "", verdict: str = "") -> DataFrame:
    """Rows whose fields hold the text, of a model and a verdict; __empty__ asks for rows without verdict and note."""
    joined = rows.join(notes, "row_key", "left")
    fields = [c for c in ("model", "report", "file", "function", "category", "expression", "final_class", "summary", "note") if c in joined.columns]
    held = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))
    wanted = text.lower().strip()
    out = joined.where(F.contains(held, F.lit(wanted))) if wanted else joined
    out = out.where(F.col("model") == model) if model else out
    return out.where(_blank_note()) if verdict == EMPTY_FILTER else out.where(F.col("verdict") == verdict) if verdict else out


def stats(rows: DataFrame, visible: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: models, rows, visible, annotated, and rows that the pipeline confirmed or called false positives."""
    marked = rows.select("row_key", "model", "final_class").join(notes, "row_key", "left")
    out = marked.agg(F.count_distinct("model").alias("models"), F.count("*").alias("rows"), F.count_if(~_blank_note()).alias("annotated"), F.count_if(F.col("final_class") == "llm_confirmed_by_esbmc").alias("confirmed"), F.count_if(F.col("final_class") == "llm_false_positive").alias("false_positives"))
    return out.join(F.broadcast(visible.agg(F.count("*").alias("visible"))))  # one row each


def annotated(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows that have a verdict or a note, with both: what an export of annotations holds."""
    return rows.join(notes, "row_key").where(~_blank_note())


def upsert_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes replace notes of the same key; one with blank verdict and note deletes."""
    kept = notes.join(changes.select("row_key"), "row_key", "left_anti").unionByName(changes)
    return kept.where((F.coalesce("verdict", F.lit("")) != "") | (F.coalesce("note", F.lit("")) != ""))
