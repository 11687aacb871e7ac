"""Queries of matching, counting, metrics, intervals and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import bootstrap, classify, evaluation, lineage, matching, reports
from ..sources import notes
from . import fixtures as X

TURNS = 2000


def _inputs(spark, d):
    return (X.bound(spark, d, s) for s in (X.CASES, X.EXPECTED, X.FINDINGS, X.DIRECT))


def _bugs(spark, d):
    return X.bound(spark, d, X.FINDINGS).where("verifiable"), X.bound(spark, d, X.EXPECTED).where("verifiable")


def _counts(spark, d):
    cases, expected, findings, direct = _inputs(spark, d)
    return evaluation.case_counts(cases, expected, findings, direct)


def _by_model(spark, d):
    return _counts(spark, d).join(X.bound(spark, d, X.CASES), "case_id")


def match_verdicts(spark, d):
    return matching.match_verdicts(*_bugs(spark, d)).withColumn("n", F.col("n").cast("long"))


def match_rows(spark, d):
    """Over all files of a model, so that a key has many rows."""
    found, expected = _bugs(spark, d)
    told = found.select("model", "category", (F.col("case_id") * 10 + F.col("rule")).alias("pos"), "rule")
    wanted = expected.select("model", "category", F.col("case_id").alias("ord"), "function")
    out = matching.match_rows(told, wanted, ["model", "category"])
    return out.select("model", "category", "verdict", "rank", F.col("found.pos").alias("finding"), F.col("found.rule").alias("rule"), F.col("expected.ord").alias("expectation"), F.col("expected.function").alias("function"))


def match_per_category(spark, d):
    return matching.match_counts(*_bugs(spark, d)).groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def category_counts(spark, d):
    return evaluation.category_counts(X.bound(spark, d, X.EXPECTED), X.bound(spark, d, X.FINDINGS))


def case_counts(spark, d):
    return _counts(spark, d)


def missing_file_counts(spark, d):
    return evaluation.totals(evaluation.missing_file_counts(X.bound(spark, d, X.CASES), X.bound(spark, d, X.EXPECTED)))


def totals(spark, d):
    return evaluation.totals(_counts(spark, d))


def rates(spark, d):
    return evaluation.rates(evaluation.totals(_counts(spark, d)))


def leaderboard(spark, d):
    return evaluation.rates(evaluation.totals(_by_model(spark, d), ["model"]), ["model"])


def missed_multiset(spark, d):
    native = X.bound(spark, d, X.DIRECT).where("status = 'violation_found'").withColumnRenamed("property", "category")
    return matching.missed(native, X.bound(spark, d, X.FINDINGS).where("verifiable"))


def missed_bug_rows(spark, d):
    direct = X.bound(spark, d, X.DIRECT).withColumnRenamed("property", "category")
    found = X.bound(spark, d, X.FINDINGS).where("verifiable")
    lost = classify.missed_bugs(direct.where("status = 'violation_found'"), found, matching.KEYS)
    seen = classify.direct_observations(direct.where("status = 'no_violation_found'"))
    return lost.unionByName(seen).select("case_id", "function", "category", "stage", "finding_type", "verifiable", "final_class")


def bootstrap_ci(spark, d):
    return _rounded(bootstrap.intervals(_numbered(spark, d), bootstrap.lcg(_n_cases(spark, d), TURNS)))


def bootstrap_seeded(spark, d):
    return _rounded(bootstrap.intervals(_numbered(spark, d), bootstrap.seeded(_n_cases(spark, d), TURNS)))


def _numbered(spark, d):
    return bootstrap.numbered(lineage.cut(_counts(spark, d)), "case_id")


def _n_cases(spark, d):
    return X.bound(spark, d, X.CASES).count()


def _rounded(intervals):
    return intervals.select("metric", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


#: What a caller of the library might want to know besides: recall counts four times, and how many of the analyzer's bugs the verifier could say nothing of.
OWN_METRICS = {"hybrid_bug_f2": lambda: M.f_beta(2, "hybrid_tp", "hybrid_fp", "hybrid_fn"), "undecided_share": lambda: M.ratio(F.col("inconclusive") + F.col("skipped"), F.col("confirmed") + F.col("not_confirmed") + F.col("inconclusive") + F.col("skipped"))}


def own_metrics(spark, d):
    """The caller's metrics of each model, and over all models their interval."""
    extra = {k: f() for k, f in OWN_METRICS.items()}
    by_model = evaluation.rates(evaluation.totals(_by_model(spark, d), ["model"]), ["model"], extra)
    told = by_model.select("model", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in extra])).alias("x")).select("model", "x.*")
    spans = _rounded(bootstrap.intervals(_numbered(spark, d), bootstrap.lcg(_n_cases(spark, d), TURNS), extra=extra)).where(F.col("metric").isin(*extra))
    return told.join(spans, "metric")


def section_table(spark, d):
    c = {"bugs_llm_only": ("bug_tp", "bug_fp", "bug_fn"), "bugs_hybrid_pipeline": ("hybrid_tp", "hybrid_fp", "hybrid_fn"), "smells": ("smell_tp", "smell_fp", "smell_fn"), "esbmc_direct_baseline": ("direct_tp", "direct_fp", "direct_fn")}
    return reports.section_table(evaluation.totals(_by_model(spark, d), ["model"]), c)


def section_pivot(spark, d):
    return reports.section_pivot(section_table(spark, d))


def na_note(spark, d):
    t = section_table(spark, d)
    return t.select("model", "section", reports.shown_precision(F.col("precision"), F.col("tp"), F.col("fp")).alias("shown")).join(reports.needs_note(t), "model")


def hallucination_table(spark, d):
    return reports.hallucination_table(evaluation.totals(_by_model(spark, d), ["model"]))


def benchmark_report(spark, d):
    """The report of every model, flattened where JSON writers differ."""
    rows = reports.model_reports(evaluation.report_counts(*_inputs(spark, d)), backend="openai").select("report.*")
    m = "metrics.bugs_hybrid_pipeline"
    cells = F.array_join(F.transform(F.map_entries("per_category_hybrid"), lambda e: F.concat_ws(":", e["key"], e["value"]["tp"].cast("string"), e["value"]["fp"].cast("string"), e["value"]["fn"].cast("string"))), ";")
    return rows.select("model", "prompt_mode", "bound", F.col(f"{m}.f1").alias("hybrid_f1"), F.col(f"{m}.function_mcc").alias("hybrid_mcc"), F.col(f"{m}.function_tn").alias("hybrid_tn"), F.col(f"{m}.formal_confirmation_rate").alias("confirmed"), F.col(f"{m}.noise_reduction_rate").alias("noise"), F.col("hallucinations.rate").alias("hallucinations"), F.col("out_of_scope_findings.count").alias("out_of_scope"), cells.alias("per_category_hybrid"))


def _classified(spark, d):
    f = X.bound(spark, d, X.FINDINGS)
    direct = classify.first_direct(X.bound(spark, d, X.DIRECT).withColumnRenamed("status", "direct"), "direct", "function", "case_id")
    f = f.join(direct, "case_id", "left")
    final = classify.final_class(F.col("finding_type"), F.col("status"), F.col("property") == F.col("category"), F.col("direct"), F.col("case_id") % 19 == 0)
    return f.withColumn("final_class", final).withColumns({"has_guard": F.when(F.col("case_id") % 4 == 0, "true").otherwise("false"), "ast_unrecognized": F.when(F.col("case_id") % 10 == 0, "true")})


def _all_rows(spark, d):
    """Classified findings, and rows of what the verifier alone has found or seen."""
    direct = X.bound(spark, d, X.DIRECT).withColumnRenamed("property", "category")
    found = X.bound(spark, d, X.FINDINGS).where("verifiable")
    lost = classify.missed_bugs(direct.where("status = 'violation_found'"), found, matching.KEYS)
    seen = classify.direct_observations(direct.where("status = 'no_violation_found'"))
    own = _classified(spark, d).withColumn("stage", F.lit("llm_analysis"))
    return own.unionByName(lost.unionByName(seen).drop("status"), allowMissingColumns=True)


def final_classification(spark, d):
    v = classify.validation(F.col("finding_type"), F.col("has_guard"), F.col("ast_unrecognized"))
    return _classified(spark, d).select("case_id", "rule", "final_class", classify.strategy(F.col("finding_type"), F.col("status").isNotNull()).alias("strategy"), v["valid"].alias("valid"), v["has_guard"].alias("has_guard"), v["ast_unrecognized"].alias("ast_unrecognized"))


def class_counts(spark, d):
    return _classified(spark, d).groupBy("final_class").agg(F.count("*").alias("n"))


def file_rollup(spark, d):
    return classify.file_class(X.bound(spark, d, X.CASES), _all_rows(spark, d), "case_id")


def summary_block(spark, d):
    direct = X.bound(spark, d, X.DIRECT).select("case_id", F.col("status").alias("direct_status"))
    files = X.bound(spark, d, X.CASES).join(direct, "case_id", "left").withColumn("function_count", F.col("case_id") % 4)
    return classify.summary_block(files, _all_rows(spark, d))


def full_report(spark, d):
    files = X.bound(spark, d, X.CASES).select(F.col("case_id").alias("file"), F.col("case_id").alias("ord"))
    rows = _all_rows(spark, d).select(F.col("case_id").alias("file"), F.col("rule").alias("pos"), "stage", "category", "final_class")
    direct = X.bound(spark, d, X.DIRECT).select(F.col("case_id").alias("file"), F.col("status").alias("direct"))
    expected = X.bound(spark, d, X.EXPECTED).select(F.col("case_id").alias("file"), "category", "function")
    out = classify.full_report(files, rows, direct, expected)
    return out.select("file", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.transform("findings", lambda x: x["final_class"]), ",").alias("classes"), "direct", F.array_join(F.transform("ground_truth_findings", lambda x: x["category"]), ",").alias("expected"), "final_file_classification")


def report_rows(spark, d):
    run = F.when(F.col("status").isNotNull(), F.struct("status"))
    blank = F.lit("")
    rows = _classified(spark, d).select(F.col("case_id").alias("file"), F.col("rule").alias("pos"), F.lit("llm_analysis").alias("stage"), "function", "category", F.lit(None).cast("string").alias("original_category"), "finding_type", F.when(F.col("case_id") % 2 == 0, "7").otherwise("x").alias("line"), F.lit("x / y").alias("expression"), F.lit("low").alias("confidence"), blank.alias("explanation"), F.array(blank).alias("evidence"), "verifiable", blank.alias("expected_exception"), "has_guard", "ast_unrecognized", "final_class", classify.interpretation(F.col("final_class"), F.col("category"), F.lit("x / y"), F.lit("low"), F.col("status")).alias("interpretation"), run.alias("run"))
    return classify.report_rows(rows, "m").select("file", "pos", "model", "original_category", "mvp_scope", "discard_reason", "line", "validation_strategy", F.col("esbmc_function.status").alias("run"), "final_classification", "interpretation")


def _annotations(spark, d):
    rows = _classified(spark, d).select("model", F.concat(F.lit("a/b/"), F.col("case_id").cast("string"), F.lit(".py")).alias("file"), "function", "category", F.col("rule").alias("line"), F.lit("x / y").alias("expression"), "final_class", F.lit("llm_analysis").alias("stage"), "case_id")
    return reports.annotation_rows(rows)


def _notes(spark, d):
    rows = _annotations(spark, d).where("case_id % 6 = 0").select("row_key").distinct()
    return rows.select("row_key", F.when(F.crc32("row_key") % 2 == 0, "confirmed").otherwise("false_positive").alias("verdict"), F.lit("seen").alias("note"))


def annotation_rows(spark, d):
    return _annotations(spark, d).select("case_id", "line", "row_key")


def annotation_search(spark, d):
    return reports.search(_annotations(spark, d), _notes(spark, d), text="Division", verdict=reports.EMPTY_FILTER).select("case_id", "line", "final_class")


def annotation_stats(spark, d):
    rows, notes = _annotations(spark, d), _notes(spark, d)
    return reports.stats(rows, reports.search(rows, notes, text="division"), notes)


def notes_table(spark, d):
    """Notes are entered, some are changed and some deleted, and the table is read again."""
    table = notes.NotesTable(spark, lineage.shared_folder(spark, "notes"))
    rows = _annotations(spark, d).where("case_id % 6 = 0")
    table.upsert(rows.select("row_key", F.when(F.col("line") % 2 == 0, "confirmed").otherwise("false_positive").alias("verdict"), F.lit("seen").alias("note")))
    gone = F.col("line") % 3 == 0
    table.upsert(rows.where("line <> 5").select("row_key", F.when(gone, "").otherwise("confirmed").alias("verdict"), F.when(~gone, F.concat(F.lit("again "), "line")).alias("note")))
    return table.read()


_B = f"""cases AS ({X.CASES}), expected AS ({X.EXPECTED}), findings AS ({X.FINDINGS}), direct AS ({X.DIRECT})"""


def _match_sql(name, found, expected):
    k = "case_id, category, function"
    return f"""{name} AS (SELECT {k}, least(coalesce(g, 0), coalesce(e, 0)) AS tp, greatest(coalesce(g, 0) - coalesce(e, 0), 0) AS fp, greatest(coalesce(e, 0) - coalesce(g, 0), 0) AS fn
  FROM (SELECT {k}, count(*) AS g FROM {found} GROUP BY {k}) a FULL JOIN (SELECT {k}, count(*) AS e FROM {expected} GROUP BY {k}) b USING ({k}))"""


_BUGS, _EXP = "(SELECT * FROM findings WHERE verifiable)", "(SELECT * FROM expected WHERE verifiable)"
_SMELLS = "(SELECT * FROM findings WHERE finding_type = 'smell_heuristic' AND NOT verifiable)"
_NATIVE = "(SELECT case_id, function, property AS category FROM direct WHERE status = 'violation_found')"
_VERDICT = "CASE WHEN status = 'violation_found' AND property = category THEN 'confirmed' WHEN status = 'violation_found' THEN 'inconclusive' WHEN status = 'no_violation_found' THEN 'not_confirmed' WHEN status = 'skipped' THEN 'skipped' ELSE 'inconclusive' END"
_sum = lambda t, c: f"coalesce((SELECT sum({c}) FROM {t} WHERE {t}.case_id = cases.case_id), 0)"
_cnt = lambda t, w: f"(SELECT count(*) FROM {t} WHERE {t}.case_id = cases.case_id AND {w})"
def counts_sql(base):
    """CTEs from cases, expected, findings and direct (given by `base`) to counts."""
    return f"""{base}, judged AS (SELECT *, {_VERDICT} AS verdict FROM findings WHERE verifiable),
{_match_sql('mb', _BUGS, _EXP)}, {_match_sql('ms', _SMELLS, "(SELECT * FROM expected WHERE NOT verifiable AND category <> 'clean')")},
{_match_sql('mh', "(SELECT * FROM judged WHERE verdict = 'confirmed')", _EXP)}, {_match_sql('md', _NATIVE, _EXP)}, {_match_sql('mm', _BUGS, _NATIVE)},
stray AS (SELECT j.case_id, j.category FROM judged j WHERE verdict = 'inconclusive' AND NOT EXISTS (SELECT 1 FROM expected e WHERE e.verifiable AND e.case_id = j.case_id AND e.category = j.category AND e.function = j.function)),
native AS (SELECT * FROM direct WHERE status = 'violation_found'),
raw AS (SELECT case_id, model, EXISTS (SELECT 1 FROM expected e WHERE e.case_id = cases.case_id AND e.category = 'clean') AS clean, EXISTS (SELECT 1 FROM expected e WHERE e.case_id = cases.case_id AND e.verifiable) AS bugged,
  {', '.join(f"{_sum(t, c)} AS {p}_{c}" for t, p in (('mb', 'b'), ('ms', 's'), ('mh', 'h'), ('md', 'd')) for c in ('tp', 'fp', 'fn'))},
  {_cnt('findings', 'verifiable')} AS n_bugs, {_cnt('findings', "NOT verifiable AND finding_type = 'smell_heuristic'")} AS n_smells, {_cnt('findings', "finding_type = 'llm_false_positive'")} AS hallucinations,
  {_cnt('findings', "NOT verifiable AND finding_type = 'suspected_bug'")} AS ghosts, {_cnt('findings', "finding_type = 'out_of_scope_finding'")} AS out_of_scope, {_cnt('stray', 'TRUE')} AS n_stray,
  {', '.join(f"{_cnt('judged', f"verdict = '{v}'")} AS {v}" for v in ('confirmed', 'not_confirmed', 'inconclusive', 'skipped'))}, {_cnt('native', 'TRUE')} AS native_bugs, {_sum('mm', 'fn')} AS missed_by_analyzer FROM cases),
flows AS (SELECT *, CASE WHEN clean THEN 0 ELSE b_tp END AS bug_tp, CASE WHEN clean THEN 0 ELSE b_fn END AS bug_fn, CASE WHEN clean THEN n_bugs ELSE b_fp END + hallucinations + ghosts AS bug_fp,
  CASE WHEN clean THEN 0 ELSE s_tp END AS smell_tp, CASE WHEN clean THEN 0 ELSE s_fn END AS smell_fn, CASE WHEN clean THEN n_smells ELSE s_fp END AS smell_fp,
  h_tp AS hybrid_tp, h_fp + n_stray AS hybrid_fp, h_fn AS hybrid_fn, d_tp AS direct_tp, d_fp AS direct_fp, d_fn AS direct_fn FROM raw),
wide AS (SELECT *, {', '.join(f"CASE WHEN bugged AND {c}_tp > 0 THEN 1 ELSE 0 END AS {f}_tp, CASE WHEN bugged AND {c}_tp = 0 THEN 1 ELSE 0 END AS {f}_fn, CASE WHEN NOT bugged AND clean AND {c}_fp > 0 THEN 1 ELSE 0 END AS {f}_fp, CASE WHEN NOT bugged AND clean AND {c}_fp = 0 THEN 1 ELSE 0 END AS {f}_tn" for c, f in (('bug', 'func'), ('hybrid', 'hybrid_func'), ('direct', 'direct_func')))} FROM flows),
counts AS (SELECT case_id, model, {', '.join(f"CAST({c} AS BIGINT) AS {c}" for c in evaluation.COUNTERS)} FROM wide)"""


_COUNTS = counts_sql(_B)
CATEGORY_SQL = """clean_cases AS (SELECT case_id FROM expected GROUP BY case_id HAVING bool_and(category = 'clean')),
verdicts AS (SELECT 'llm' AS flow, case_id, category, tp, fp, fn FROM (SELECT * FROM mb UNION ALL SELECT * FROM ms) m WHERE case_id NOT IN (SELECT case_id FROM clean_cases)
  UNION ALL SELECT 'llm', case_id, category, 0, 1, 0 FROM findings WHERE case_id IN (SELECT case_id FROM clean_cases) AND (verifiable OR finding_type = 'smell_heuristic')
  UNION ALL SELECT 'llm', case_id, category, 0, 1, 0 FROM findings WHERE finding_type = 'llm_false_positive' OR (finding_type = 'suspected_bug' AND NOT verifiable)
  UNION ALL SELECT 'hybrid', case_id, category, tp, fp, fn FROM mh UNION ALL SELECT 'hybrid', case_id, category, 0, 1, 0 FROM stray)
SELECT flow, category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM verdicts GROUP BY flow, category HAVING sum(tp) + sum(fp) + sum(fn) > 0"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in evaluation.COUNTERS)
_div = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / ({b}) END"


def _metric_sql():
    out = {}
    for flow, (c, f) in {**evaluation.FLOWS, "smell": ("smell", None)}.items():
        tp, fp, fn = f"{c}_tp", f"{c}_fp", f"{c}_fn"
        name = "smell" if f is None else f"{flow}_bug"
        out |= {f"{name}_precision": _div(tp, f"{tp} + {fp}"), f"{name}_recall": _div(tp, f"{tp} + {fn}"), f"{name}_f1": _div(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")}
        if f:
            t, p, n, m = (f"CAST({f}_{x} AS DOUBLE)" for x in ("tp", "fp", "fn", "tn"))
            root = f"sqrt(({t} + {p}) * ({t} + {n}) * ({m} + {p}) * ({m} + {n}))"
            out[f"{name}_mcc"] = f"CASE WHEN {root} = 0 THEN 0e0 ELSE ({t} * {m} - {p} * {n}) / {root} END"
    return out


_METRICS = _metric_sql()
_RATES = _METRICS | {f"{flow}_accuracy": _div(f"{f}_tp + {f}_tn", f"{f}_tp + {f}_fp + {f}_fn + {f}_tn") for flow, (_, f) in evaluation.FLOWS.items()}
_RATES |= {"hallucination_rate": _div("hallucinations", "bug_tp + bug_fp - ghosts"), "confirmation_rate": _div("confirmed", "confirmed + not_confirmed + inconclusive"), "noise_reduction": _div("(bug_fp - hybrid_fp)", "bug_fp")}
_RATE_SQL = ", ".join(f"round({v}, 4) AS {k}" for k, v in _RATES.items())
_SECTIONS = {"bugs_llm_only": "bug", "bugs_hybrid_pipeline": "hybrid", "smells": "smell", "esbmc_direct_baseline": "direct"}
_TABLE = f"{_COUNTS}, t AS (SELECT model, {_SUMS} FROM counts GROUP BY model), sections AS (" + " UNION ALL ".join(f"SELECT model, '{s}' AS section, round({_div(f'{c}_tp', f'{c}_tp + {c}_fp')}, 4) AS \"precision\", round({_div(f'{c}_tp', f'{c}_tp + {c}_fn')}, 4) AS recall, round({_div(f'2 * {c}_tp', f'2 * {c}_tp + {c}_fp + {c}_fn')}, 4) AS f1, {c}_tp AS tp, {c}_fp AS fp, {c}_fn AS fn FROM t" for s, c in _SECTIONS.items()) + ")"
def _ci_sql(metrics):
    return f"""WITH {_COUNTS}, n AS (SELECT count(*) AS n FROM counts), idx AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS case_idx FROM counts),
grid AS (SELECT b, ((b * 7919 + pos * 104729 + 12345) * 48271 % 2147483647) % n AS case_idx FROM n, unnest(range({TURNS})) AS g(b), (SELECT unnest(range(n)) AS pos FROM n) p),
s AS (SELECT b, {_SUMS} FROM grid JOIN idx USING (case_idx) GROUP BY b), long AS ({' UNION ALL '.join(f"SELECT '{k}' AS metric, {v} AS value FROM s" for k, v in metrics.items())}),
r AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) AS r FROM long)
SELECT metric, round(max(value) FILTER (WHERE r = {int(0.025 * TURNS) + 1}), 4) AS low, round(max(value) FILTER (WHERE r = {min(int(0.975 * TURNS), TURNS - 1) + 1}), 4) AS high FROM r GROUP BY metric"""


_CI = _ci_sql(_METRICS)
_OWN = {"hybrid_bug_f2": _div("5 * hybrid_tp", "5 * hybrid_tp + 4 * hybrid_fn + hybrid_fp"), "undecided_share": _div("(inconclusive + skipped)", "confirmed + not_confirmed + inconclusive + skipped")}
_OWN_SQL = f"WITH ci AS ({_ci_sql(_OWN)}), {_COUNTS}, t AS (SELECT model, {_SUMS} FROM counts GROUP BY model), told AS ({' UNION ALL '.join(f"SELECT model, '{k}' AS metric, round({v}, 4) AS value FROM t" for k, v in _OWN.items())}) SELECT metric, model, value, low, high FROM told JOIN ci USING (metric)"
_FINAL = """CASE WHEN finding_type IN ('out_of_scope_finding', 'llm_false_positive') THEN finding_type WHEN finding_type = 'smell_heuristic' THEN 'heuristic_smell_only' WHEN finding_type <> 'suspected_bug' THEN 'skipped_not_verifiable'
  WHEN case_id % 19 = 0 THEN 'llm_only_suspected' WHEN status IS NULL OR status = 'skipped' THEN CASE WHEN dstatus = 'violation_found' THEN 'esbmc_native_bug' ELSE 'skipped_not_verifiable' END
  WHEN status = 'violation_found' AND property = category THEN 'llm_confirmed_by_esbmc' WHEN status = 'violation_found' THEN 'esbmc_inconclusive' WHEN status = 'no_violation_found' THEN 'not_confirmed_within_bound' ELSE 'esbmc_inconclusive' END"""
_CLASSED = f"{_B}, ds AS (SELECT case_id, min_by(status, function) AS dstatus FROM direct GROUP BY case_id), classed AS (SELECT findings.*, {_FINAL} AS final_class FROM findings LEFT JOIN ds USING (case_id))"
_ALL = f"""{_CLASSED}, alone AS (SELECT d.case_id, d.status, CASE WHEN d.status = 'violation_found' THEN 'llm_missed_esbmc_bug' ELSE 'clean' END AS final_class FROM direct d
  WHERE d.status = 'no_violation_found' OR (d.status = 'violation_found' AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.verifiable AND f.case_id = d.case_id AND f.category = d.property AND f.function = d.function))),
every AS (SELECT case_id, rule, final_class FROM classed UNION ALL SELECT case_id, NULL, final_class FROM alone)"""
_FILES = f"""{_ALL}, ranks AS (SELECT * FROM (VALUES (1, 'llm_confirmed_by_esbmc'), (2, 'esbmc_native_bug'), (3, 'llm_missed_esbmc_bug'), (4, 'llm_false_positive'), (5, 'not_confirmed_within_bound'), (6, 'esbmc_inconclusive'), (7, 'out_of_scope_finding'), (8, 'heuristic_smell_only'), (9, 'skipped_not_verifiable')) t(r, final_class)),
files AS (SELECT cases.case_id, coalesce(min_by(ranks.final_class, r), 'clean') AS file_class FROM cases LEFT JOIN every ON every.case_id = cases.case_id LEFT JOIN ranks ON ranks.final_class = every.final_class GROUP BY cases.case_id)"""
_KEYED = f"{_CLASSED}, keyed AS (SELECT case_id, rule AS line, model, function, category, final_class, concat_ws('::', model, CAST(case_id AS VARCHAR) || '.py', function, category, CAST(rule AS VARCHAR), 'x / y', final_class) AS row_key FROM classed)"
_n = lambda alias, *names: f"(SELECT count(*) FROM classed WHERE final_class IN ({', '.join(repr(x) for x in names)})) AS {alias}"
_TOLD = """CASE final_class WHEN 'out_of_scope_finding' THEN category || ' is not examined' WHEN 'heuristic_smell_only' THEN 'an opinion about ' || category || ', confidence low' WHEN 'llm_false_positive' THEN 'the source has no place for ' || category || ' (x / y)'
  WHEN 'skipped_not_verifiable' THEN category || ' (x / y) was not verified' WHEN 'llm_only_suspected' THEN category || ' (x / y) is suspected; nobody has verified it' WHEN 'llm_confirmed_by_esbmc' THEN 'the verifier reached the suspected ' || category || ' (x / y)'
  WHEN 'not_confirmed_within_bound' THEN 'the verifier found no ' || category || ' (x / y) within the bound' WHEN 'esbmc_native_bug' THEN 'the verifier found ' || category || ' (x / y) by itself: ' || coalesce(status, 'no details') ELSE 'the verifier neither confirms nor refutes ' || category || ' (x / y): ' || coalesce(status, 'no details') END"""
_MODELS = f"{_COUNTS}, {CATEGORY_SQL.split('SELECT flow')[0]}, t AS (SELECT model, {_SUMS} FROM counts GROUP BY model), hc AS (SELECT model, string_agg(category || ':' || tp || ':' || fp || ':' || fn, ';' ORDER BY category) AS cells FROM (SELECT model, category, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM verdicts JOIN cases USING (case_id) WHERE flow = 'hybrid' GROUP BY model, category) g WHERE tp + fp + fn > 0 GROUP BY model)"

PLANS = {
    "q_match_verdicts": (match_verdicts, f"WITH {_B}, {_match_sql('m', _BUGS, _EXP)} SELECT case_id, category, function, verdict, unnest(range(1, CAST(k AS BIGINT) + 1)) AS n FROM (SELECT case_id, category, function, 'tp' AS verdict, tp AS k FROM m UNION ALL SELECT case_id, category, function, 'fp', fp FROM m UNION ALL SELECT case_id, category, function, 'fn', fn FROM m) v WHERE k > 0"),
    "q_match_rows": (match_rows, f"WITH {_B}, f AS (SELECT model, category, case_id * 10 + rule AS finding, rule, row_number() OVER (PARTITION BY model, category ORDER BY case_id * 10 + rule) AS rank FROM findings WHERE verifiable), e AS (SELECT model, category, case_id AS expectation, function, row_number() OVER (PARTITION BY model, category ORDER BY case_id) AS rank FROM expected WHERE verifiable) SELECT model, category, CASE WHEN expectation IS NULL THEN 'fp' WHEN finding IS NULL THEN 'fn' ELSE 'tp' END AS verdict, rank, finding, rule, expectation, function FROM f FULL JOIN e USING (model, category, rank)"),
    "q_match_per_category": (match_per_category, f"WITH {_B}, {_match_sql('m', _BUGS, _EXP)} SELECT category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM m GROUP BY category"),
    "q_category_counts": (category_counts, f"WITH {_COUNTS}, {CATEGORY_SQL}"),
    "q_case_counts": (case_counts, f"WITH {_COUNTS} SELECT * EXCLUDE (model) FROM counts"),
    "q_missing_file_counts": (missing_file_counts, f"WITH {_B}, p AS (SELECT case_id, count(*) FILTER (WHERE verifiable) AS b, count(*) FILTER (WHERE NOT verifiable AND category <> 'clean') AS s FROM expected GROUP BY case_id), q AS (SELECT CAST(sum(b) AS BIGINT) AS b, CAST(sum(s) AS BIGINT) AS s, count(*) FILTER (WHERE b > 0) AS f FROM p) SELECT {', '.join({'bug_fn': 'b', 'hybrid_fn': 'b', 'direct_fn': 'b', 'smell_fn': 's', 'func_fn': 'f', 'hybrid_func_fn': 'f', 'direct_func_fn': 'f'}.get(c, 'CAST(0 AS BIGINT)') + f' AS {c}' for c in evaluation.COUNTERS)} FROM q"),
    "q_totals": (totals, f"WITH {_COUNTS} SELECT {_SUMS} FROM counts"),
    "q_rates": (rates, f"WITH {_COUNTS}, t AS (SELECT {_SUMS} FROM counts) SELECT {_RATE_SQL} FROM t"),
    "q_model_leaderboard": (leaderboard, f"WITH {_COUNTS}, t AS (SELECT model, {_SUMS} FROM counts GROUP BY model) SELECT model, {_RATE_SQL} FROM t"),
    "q_missed_multiset": (missed_multiset, f"WITH {_B}, {_match_sql('m', _BUGS, _NATIVE)} SELECT case_id, category, function, CAST(fn AS BIGINT) AS missed FROM m WHERE fn > 0"),
    "q_missed_bug_rows": (missed_bug_rows, f"WITH {_B} SELECT case_id, function, 'esbmc_detected' AS category, 'esbmc_direct' AS stage, 'suspected_bug' AS finding_type, true AS verifiable, 'llm_missed_esbmc_bug' AS final_class FROM direct d WHERE status = 'violation_found' AND NOT EXISTS (SELECT 1 FROM findings f WHERE f.verifiable AND f.case_id = d.case_id AND f.category = d.property AND f.function = d.function) UNION ALL SELECT case_id, function, 'esbmc_direct', 'esbmc_direct', 'direct_observation', false, 'clean' FROM direct WHERE status = 'no_violation_found'"),
    "q_bootstrap_ci": (bootstrap_ci, _CI),
    "q_bootstrap_seeded": (bootstrap_seeded, None),
    "q_own_metrics": (own_metrics, _OWN_SQL),
    "q_section_table": (section_table, f"WITH {_TABLE} SELECT * FROM sections"),
    "q_section_pivot": (section_pivot, f"WITH {_TABLE} SELECT model, {', '.join(f"max(f1) FILTER (WHERE section = '{s}') AS {s}" for s in reports.SECTIONS)} FROM sections GROUP BY model"),
    "q_na_note": (na_note, f"WITH {_TABLE}, notes AS (SELECT model, tp = 0 AND fp = 0 AS note FROM sections WHERE section = 'esbmc_direct_baseline') SELECT model, section, CASE WHEN tp = 0 AND fp = 0 THEN 'N/A' ELSE printf('%.4f', \"precision\") END AS shown, note FROM sections JOIN notes USING (model)"),
    "q_hallucination_table": (hallucination_table, f"WITH {_COUNTS}, t AS (SELECT model, {_SUMS} FROM counts GROUP BY model) SELECT model, hallucinations AS \"count\", round({_div('hallucinations', 'bug_tp + bug_fp - ghosts')}, 4) AS rate FROM t"),
    "q_benchmark_report": (benchmark_report, f"WITH {_MODELS} SELECT model, 'raw' AS prompt_mode, 5 AS bound, round({_METRICS['hybrid_bug_f1']}, 4) AS hybrid_f1, round({_METRICS['hybrid_bug_mcc']}, 4) AS hybrid_mcc, hybrid_func_tn AS hybrid_tn, round({_RATES['confirmation_rate']}, 4) AS confirmed, round({_RATES['noise_reduction']}, 4) AS noise, round({_RATES['hallucination_rate']}, 4) AS hallucinations, out_of_scope, coalesce(cells, '') AS per_category_hybrid FROM t LEFT JOIN hc USING (model)"),
    "q_final_classification": (final_classification, f"WITH {_CLASSED} SELECT case_id, rule, final_class, CASE WHEN status IS NOT NULL THEN 'esbmc' WHEN finding_type = 'smell_heuristic' THEN 'heuristic' ELSE 'skipped' END AS strategy, finding_type IN ('suspected_bug', 'smell_heuristic') AS valid, finding_type = 'suspected_bug' AND case_id % 4 = 0 AS has_guard, CASE WHEN finding_type = 'suspected_bug' THEN case_id % 10 = 0 END AS ast_unrecognized FROM classed"),
    "q_class_counts": (class_counts, f"WITH {_CLASSED} SELECT final_class, count(*) AS n FROM classed GROUP BY final_class"),
    "q_file_rollup": (file_rollup, f"WITH {_FILES} SELECT * FROM files"),
    "q_summary_block": (summary_block, f"WITH {_CLASSED} SELECT count(*) AS total_files, (SELECT count(*) FROM classed) AS total_llm_findings, (SELECT count(*) FROM direct WHERE status = 'violation_found') AS total_esbmc_direct_violations, count(*) FILTER (WHERE case_id % 4 = 0) AS total_no_vcc_generated, {_n('total_confirmed_by_esbmc', 'llm_confirmed_by_esbmc')}, {_n('total_llm_false_positives', 'llm_false_positive')}, {_n('total_smells', 'heuristic_smell_only')}, {_n('total_out_of_scope_findings', 'out_of_scope_finding')}, {_n('total_inconclusive', 'esbmc_inconclusive', 'not_confirmed_within_bound', 'skipped_not_verifiable')} FROM cases"),
    "q_full_report": (full_report, f"WITH {_FILES}, g AS (SELECT case_id, count(*) AS n, string_agg(final_class, ',' ORDER BY rule) AS c FROM classed GROUP BY case_id), x AS (SELECT case_id, string_agg(category, ',' ORDER BY category) AS e FROM expected GROUP BY case_id) SELECT case_id AS file, coalesce(n, 0) AS n_findings, coalesce(c, '') AS classes, direct.status AS direct, coalesce(e, '') AS expected, file_class AS final_file_classification FROM files LEFT JOIN g USING (case_id) LEFT JOIN x USING (case_id) LEFT JOIN direct USING (case_id)"),
    "q_report_rows": (report_rows, f"WITH {_CLASSED} SELECT case_id AS file, rule AS pos, 'm' AS model, category AS original_category, final_class <> 'out_of_scope_finding' AS mvp_scope, CASE WHEN final_class = 'out_of_scope_finding' THEN 'category_outside_mvp' ELSE '' END AS discard_reason, CAST(CASE WHEN case_id % 2 = 0 THEN 7 ELSE 0 END AS INTEGER) AS line, CASE WHEN status IS NOT NULL THEN 'esbmc' WHEN finding_type = 'smell_heuristic' THEN 'heuristic' ELSE 'skipped' END AS validation_strategy, status AS run, final_class AS final_classification, {_TOLD} AS interpretation FROM classed"),
    "q_annotation_rows": (annotation_rows, f"WITH {_KEYED} SELECT case_id, line, row_key FROM keyed"),
    "q_annotation_search": (annotation_search, f"WITH {_KEYED} SELECT case_id, line, final_class FROM keyed WHERE lower(concat_ws(' ', model, category, final_class)) LIKE '%division%' AND case_id % 6 <> 0"),
    "q_notes_table": (notes_table, f"WITH {_KEYED} SELECT row_key, CASE WHEN line = 5 THEN 'false_positive' ELSE 'confirmed' END AS verdict, CASE WHEN line = 5 THEN 'seen' ELSE 'again ' || CAST(line AS VARCHAR) END AS note FROM keyed WHERE case_id % 6 = 0 AND line % 3 <> 0"),
    "q_annotation_stats": (annotation_stats, f"WITH {_KEYED} SELECT count(DISTINCT model) AS models, count(*) AS rows, count(*) FILTER (WHERE case_id % 6 = 0) AS annotated, count(*) FILTER (WHERE final_class = 'llm_confirmed_by_esbmc') AS confirmed, count(*) FILTER (WHERE final_class = 'llm_false_positive') AS false_positives, count(*) FILTER (WHERE category LIKE '%division%') AS visible FROM keyed"),
}
