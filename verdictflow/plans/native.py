"""Queries of parsing and file formats: sources, ground-truth files and reports are made from the driver's tables, one
or more for each row, and read by the operators. Their SQL restates what the templates hold, row by row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts
from ..operators import evaluation, lint, presentation, reports
from ..sources import code, ground_truth
from . import evaluation as E
from . import fixtures as X


def _sources(spark, d):
    return X.bound(spark, d, X.SOURCES)


def _units(spark, d):
    return code.extract_units(_sources(spark, d)).withColumn("file", F.element_at(F.split("path", "/"), -1))


def ast_units(spark, d):
    return _units(spark, d).select("file", "ord", "name", "qualname", "start_line", "end_line", F.array_join("parameters", ",").alias("parameters"), "line_count", "parameter_count", "branch_count", "loop_count", "operation_count", F.array_join("guards", ";").alias("guards"), "is_async")


def unit_operations(spark, d):
    return _units(spark, d).select("file", "qualname", F.explode("operations").alias("o")).select("file", "qualname", "o.*")


def ast_exists(spark, d):
    """Each file's units are asked for one expression."""
    wanted = _sources(spark, d).select("path", "expression").withColumn("x", code.expression_facts(F.col("expression")))
    found = F.coalesce(F.array_contains("exec_exprs", F.col("x.normal")), F.lit(False))
    asserted = F.coalesce(F.array_contains("assert_tests", F.col("x.assertion")), F.lit(False))
    hits = _units(spark, d).join(wanted, "path").select("file", "qualname", "expression", found.alias("executable"), asserted.alias("asserted"))
    return hits.where("executable or asserted")


def const_denominator(spark, d):
    return X.bound(spark, d, X.DIVISIONS).select("conv_id", "turn", "expression", code.expression_facts(F.col("expression"))["constant_divisor"].alias("constant"))


def prompt_modes(spark, d):
    u = _units(spark, d)
    raw, hints = prompts.raw_prompt(), prompts.hints_prompt()
    leaks = F.contains(raw, F.col("path")) | F.contains(raw, F.lit("Guards")) | F.contains(raw, F.lit("operation_count"))
    told = lambda c: F.contains(hints, F.lit(c))
    return u.select("file", "qualname", leaks.alias("leaks"), F.contains(raw, F.col("source")).alias("source"), F.contains(raw, F.lit('"parameter_count":')).alias("sizes"), told("- line 2: total // parts").alias("division"), told("k > 0").alias("guard"), F.size(prompts.assertion_lines(F.col("source"))).alias("assertions"))


def _items(spark, d):
    """Expected rows, read from one ground-truth file for each conversation."""
    told = X.bound(spark, d, X.LABELLED_ITEMS)
    fields = [f.split()[0] for f in ground_truth.ITEM.split(", ")]
    each = told.groupBy("conv_id", "json_path", "told_category").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.struct(*fields).alias("item")))), lambda x: x["item"]).alias("items"))
    whole = F.to_json(F.struct(F.col("told_category").alias("category"), F.lit("made").alias("description"), F.when(F.col("conv_id") % 10 != 9, F.col("items")).alias("items")))
    return ground_truth.parse_ground_truth(each.select("json_path", F.when(F.col("conv_id") % 10 == 8, "no JSON").otherwise(whole).alias("text")))


def gt_load(spark, d):
    return _items(spark, d).drop("json_path").withColumn("ord", F.col("ord").cast("long"))


def lint_native(spark, d):
    sources = _sources(spark, d).select("path", "text")
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    facts = code.file_facts(sources).select(file, "*")
    out = lint.case_issues(_items(spark, d), sources.select(file, "text"), facts, _units(spark, d))
    return out.select("id", F.array_join("issues", ",").alias("issues"))


def _benchmark_files(spark, d):
    """(file, text): every model's benchmark report as JSON, a manifest, and a file that only looks like a report."""
    told = reports.model_reports(evaluation.report_counts(*E._inputs(spark, d)), backend="openai")
    written = told.select("model", F.to_json("report").alias("text"))
    named = F.explode(F.array(F.concat(F.lit("benchmark_"), "model", F.lit(".json")), F.concat(F.lit("report_"), "model", F.lit(".json")), F.lit("benchmark_matrix_manifest.json")))
    return written.select(named.alias("file"), "text")


def reports_load(spark, d):
    rows = ground_truth.per_category(ground_truth.parse_reports(_benchmark_files(spark, d)))
    return rows.select("file", "category", "precision", "recall", "f1", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def report_layouts(spark, d):
    """Every case is a report of its own, in one of the three layouts."""
    rows = X.bound(spark, d, X.REPORT_ROWS)
    result = F.struct("function", "category", "expression", "line", F.col("final_class").alias("final_classification"), "confidence", "reasoning", "interpretation")
    metadata = F.struct("expression", "line").alias("metadata")
    finding = F.struct("stage", "category", "confidence", F.col("reasoning").alias("explanation"), metadata).alias("finding")
    unit = F.struct(F.col("function").alias("unit_name"), F.col("path").alias("source_file"), F.col("final_class").alias("final_classification"), finding)
    listed = lambda x: F.transform(F.sort_array(F.collect_list(F.struct("rule", x.alias("x")))), lambda r: r["x"])
    each = rows.groupBy("case_id", "model", "path").agg(listed(result).alias("llm_results"), listed(unit).alias("units"), F.count("*").alias("n"), F.max("rule").alias("top"))
    full = F.to_json(F.struct(F.struct("model").alias("experiment"), F.struct("n").alias("summary"), F.array(F.struct(F.col("path").alias("file"), "llm_results")).alias("files")))
    bench = F.to_json(F.struct("model", F.lit("openai").alias("backend"), F.struct(F.struct((F.col("n") / 8).alias("f1")).alias("smells"), F.when(F.col("top") % 2 == 0, F.struct((F.col("top") / 8).alias("f1"))).alias("bugs")).alias("metrics")))
    kind = F.element_at(F.array(F.lit("full_"), F.lit("flat_"), F.lit("benchmark_")), (F.col("case_id") % 3 + 1).cast("int"))
    text = F.when(F.col("case_id") % 3 == 0, full).when(F.col("case_id") % 3 == 1, F.to_json("units")).otherwise(bench)
    out = reports.normalized_rows(each.select(F.concat(kind, F.col("case_id").cast("string"), F.lit(".json")).alias("file"), text.alias("report")))
    return out.withColumn("badge", reports.badge(F.col("final_class")))


def table_lines(spark, d):
    """The lines of the table of models and sections, as text and as LaTeX."""
    return presentation.lines(E.section_table(spark, d)).select("model", "section", "ascii", "latex")


def page_rows(spark, d):
    """The rows of the page of all reports."""
    return presentation.page_rows(ground_truth.parse_reports(_benchmark_files(spark, d))).select("name", "section", "html")


def _values(columns: str, *rows: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t({columns}))"


_ROW = f"c AS (SELECT *, {X.KIND} AS kind, {X.SHIFT} AS shift, {X.LITERAL} AS d, CAST(turn AS VARCHAR) AS t, {X._KEY} || '.py' AS file FROM conversations)"
_UNITS = _values(
    "kind, ord, name, qualname, first, last, parameters, line_count, parameter_count, branch_count, loop_count, operation_count, guards, is_async",
    "('share', 0, 'share_$t', 'share_$t', 4, 5, 'total,parts', 2, 2, 0, 0, 1, '', false)",
    "('share', 1, 'pick', 'pick', 8, 11, 'rows,at', 4, 2, 1, 0, 4, 'at < len(rows)', false)",
    "('share', 2, 'main', 'Box.main', 15, 22, 'self,n', 8, 2, 0, 1, 4, 'k > 0', false)",
    "('share', 3, 'inner', 'Box.main.inner', 16, 18, 'k', 3, 1, 0, 0, 1, 'k > 0', false)",
    "('share', 4, 'later', 'later', 25, 28, 'k', 4, 1, 0, 1, 0, '', true)",
    "('loose', 0, 'loose', 'loose', 4, 8, 'a,b', 5, 2, 1, 0, 0, 'b < $d;b >= 0', false)",
)
_fill = lambda c: f"replace(replace({c}, '$d', d), '$t', t)"
_UNIT_SQL = f"WITH {_ROW} SELECT file, ord, {_fill('name')} AS name, {_fill('qualname')} AS qualname, first + shift AS start_line, last + shift AS end_line, parameters, line_count, parameter_count, branch_count, loop_count, operation_count, {_fill('guards')} AS guards, is_async FROM c JOIN {_UNITS} u USING (kind)"
_OPERATIONS = _values(
    "kind, qualname, operation, expression, source_line, relative_line",
    "('share', 'share_$t', 'division', 'total // parts', 5, 2)", "('share', 'pick', 'call', 'len(rows)', 9, 2)", "('share', 'pick', 'subscript', 'rows[at]', 10, 3)",
    "('share', 'pick', 'division', 'rows[0] / $d', 11, 4)", "('share', 'pick', 'subscript', 'rows[0]', 11, 4)", "('share', 'Box.main', 'division', '$d % k', 18, 4)",
    "('share', 'Box.main', 'call', 'range(n)', 20, 6)", "('share', 'Box.main', 'call', 'inner(i)', 21, 7)", "('share', 'Box.main', 'call', 'math.sqrt(n)', 22, 8)",
    "('share', 'Box.main.inner', 'division', '$d % k', 18, 3)",
)
_OPERATION_SQL = f"WITH {_ROW} SELECT file, {_fill('qualname')} AS qualname, operation AS kind, {_fill('expression')} AS expression, source_line + shift AS line, relative_line FROM c JOIN {_OPERATIONS} o USING (kind)"
# Methods and nested functions are indented: alone they do not parse, so nothing of theirs exists or is asserted.
_EXISTS = _values("kind, qualname, asked, executable, asserted", "('share', 'share_$t', 0, true, false)", "('share', 'pick', 1, true, false)", "('share', 'pick', 4, true, false)", "('share', 'pick', 5, true, false)", "('share', 'pick', 8, true, false)", "('loose', 'loose', 6, true, true)", "('loose', 'loose', 7, false, true)")
_EXISTS_SQL = f"WITH {_ROW} SELECT file, {_fill('qualname')} AS qualname, {X.ASKED} AS expression, executable, asserted FROM c JOIN {_EXISTS} e ON e.kind = c.kind AND asked = {X.TURN_OF_ELEVEN}"
_CONSTANT_SQL = f"SELECT conv_id, turn, expression, {X.TURN_OF_ELEVEN} IN (2, 3, 4, 9) AS constant FROM ({X.DIVISIONS}) x"
_PROMPTS = _values("kind, qualname, division, guard, assertions", "('share', 'share_$t', true, false, 0)", "('share', 'pick', false, false, 0)", "('share', 'Box.main', false, true, 1)", "('share', 'Box.main.inner', false, true, 1)", "('share', 'later', false, false, 0)", "('loose', 'loose', false, false, 1)")
_PROMPT_SQL = f"WITH {_ROW} SELECT file, {_fill('qualname')} AS qualname, false AS leaks, true AS source, true AS sizes, division, guard, assertions FROM c JOIN {_PROMPTS} p USING (kind)"
_READ = f"""i AS (SELECT *, coalesce(told_category, 'out_of_bounds_' || CAST(conv_id AS VARCHAR)) AS place, coalesce(expected_category, category) AS named FROM ({X.LABELLED_ITEMS}) x WHERE conv_id % 10 NOT IN (8, 9) AND file <> '')"""
_ITEM_SQL = f"""WITH {_READ} SELECT row_number() OVER (ORDER BY json_path, turn) AS ord, CASE conv_id % 2 WHEN 0 THEN 'data/ok/bugs/' ELSE 'data/ok/set_b/' END || CASE WHEN place = 'clean' THEN '' ELSE place || '/' END || file AS source_path,
  id, file, "function", named AS category, verifiable, coalesce(should_go_to_esbmc, false) AS should_go_to_esbmc, expression, CAST(line AS INTEGER) AS line, expected_type FROM i"""
_LINT_SQL = f"""WITH {_READ}, k AS (SELECT *, {X.KIND} AS kind, file LIKE 'lost%' AS lost, conv_id % 4 = 1 AND "function" = 'pick' AS odd FROM i) SELECT id, concat_ws(',', CASE WHEN named <> 'clean' AND should_go_to_esbmc IS NULL THEN 'should_go_to_esbmc' END, CASE WHEN lost THEN 'file' END,
  CASE WHEN NOT lost AND kind = 'broken' THEN 'syntax' END, CASE WHEN NOT lost AND "function" = 'later' THEN 'function' END, CASE WHEN NOT lost AND kind = 'loose' THEN 'hints,top_level,imports' END,
  CASE WHEN NOT lost AND named <> 'clean' AND (conv_id + turn) % 7 = 3 THEN 'near_line' END, CASE WHEN NOT lost AND odd THEN 'triggerable' END, CASE WHEN NOT lost AND kind = 'share' AND named = 'clean' AND "function" <> 'later' THEN 'safe' END) AS issues FROM k"""
_LLM = f"{E._COUNTS}, {E.CATEGORY_SQL.split('SELECT flow')[0]}, g AS (SELECT model, category, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM verdicts JOIN cases USING (case_id) WHERE flow = 'llm' AND model IS NOT NULL GROUP BY model, category)"
_CATEGORIES = f"WITH {_LLM} SELECT 'benchmark_' || model || '.json' AS file, category, round({E._div('tp', 'tp + fp')}, 4) AS \"precision\", round({E._div('tp', 'tp + fn')}, 4) AS recall, round({E._div('2 * tp', '2 * tp + fp + fn')}, 4) AS f1, tp, fp, fn FROM g WHERE tp + fp + fn > 0"
_BADGE = "CASE final_class WHEN 'llm_confirmed_by_esbmc' THEN 'cls-ok' WHEN 'llm_false_positive' THEN 'cls-bad' WHEN 'not_confirmed_within_bound' THEN 'cls-mid' ELSE 'cls-neutral' END"
_blank = lambda c: f"coalesce({c}, '')"
_LAYOUTS = f"""WITH r AS ({X.REPORT_ROWS}), f AS (SELECT *, CASE case_id % 3 WHEN 0 THEN 'full_' WHEN 1 THEN 'flat_' ELSE 'benchmark_' END || CAST(case_id AS VARCHAR) AS name FROM r),
x AS (SELECT case_id, CASE case_id % 3 WHEN 0 THEN coalesce(model, name) ELSE name END AS model, name || '.json' AS report, path AS file, {_blank('"function"')} AS "function", category, {_blank('expression')} AS expression, CASE WHEN line = 0 THEN '' ELSE CAST(line AS VARCHAR) END AS line, final_class, confidence,
  CASE case_id % 3 WHEN 0 THEN coalesce(reasoning, interpretation) ELSE {_blank('reasoning')} END AS summary FROM f WHERE case_id % 3 = 0 OR (case_id % 3 = 1 AND stage <> 'esbmc_direct')),
b AS (SELECT coalesce(model, name) AS model, name || '.json' AS report, 'LLM bugs F1=' || CASE WHEN max(rule) % 2 = 0 THEN printf('%.3f', max(rule) / 8e0) ELSE '-' END || ' | Hybrid F1=- | Smells F1=' || printf('%.3f', count(*) / 8e0) AS summary FROM f WHERE case_id % 3 = 2 GROUP BY ALL)
SELECT model, report, file, "function", category, expression, line, final_class, confidence, summary, concat_ws('::', model, CAST(case_id AS VARCHAR) || '.py', "function", category, line, expression, final_class) AS row_key, {_BADGE} AS badge FROM x
UNION ALL SELECT model, report, '(benchmark)', '', 'metrics', '', '', 'benchmark', '', summary, 'benchmark::' || model || '::' || report, 'cls-neutral' FROM b"""
_CELLS = {"model": "model", "section": "section", "precision": "printf('%.4f', \"precision\")", "recall": "printf('%.4f', recall)", "f1": "printf('%.4f', f1)", "tp": "CAST(tp AS VARCHAR)", "fp": "CAST(fp AS VARCHAR)", "fn": "CAST(fn AS VARCHAR)"}
_told = lambda k: f"coalesce(c_{k}, 'N/A')"
_wide = lambda k: f"rpad({_told(k)}, CAST(greatest({len(k)}, max(length({_told(k)})) OVER ()) AS INTEGER), ' ')"
_LINE_SQL = f"""WITH {E._TABLE}, s AS (SELECT model, section, {', '.join(f'{v} AS c_{k}' for k, v in _CELLS.items())} FROM sections) SELECT model, section, rtrim({" || '  ' || ".join(map(_wide, _CELLS))}) AS ascii,
  {" || ' & ' || ".join(f"replace({_told(k)}, '_', chr(92) || '_')" for k in _CELLS)} || ' ' || chr(92) || chr(92) AS latex FROM s"""
_PAGE_SQL = f"WITH {E._TABLE} SELECT 'benchmark_' || model || '.json' AS name, section, '<tr>' || {' || '.join(f"'<td>' || {v} || '</td>'" for v in _CELLS.values())} || '</tr>' AS html FROM sections WHERE model IS NOT NULL"

PLANS = {"q_ast_units": (ast_units, _UNIT_SQL), "q_unit_operations": (unit_operations, _OPERATION_SQL), "q_ast_exists": (ast_exists, _EXISTS_SQL), "q_const_denominator": (const_denominator, _CONSTANT_SQL), "q_prompt_modes": (prompt_modes, _PROMPT_SQL), "q_gt_load": (gt_load, _ITEM_SQL), "q_reports_load": (reports_load, _CATEGORIES), "q_report_layouts": (report_layouts, _LAYOUTS), "q_lint_native": (lint_native, _LINT_SQL), "q_table_lines": (table_lines, _LINE_SQL), "q_page_rows": (page_rows, _PAGE_SQL)}
