"""Queries of analyzer responses, normalization, and data-set lint."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import findings as A
from ..operators import attempts, evaluation, flows, lineage, lint, normalize
from ..sources import code
from . import fixtures as X
from .evaluation import CATEGORY_SQL as _CATEGORY_SQL
from .evaluation import counts_sql as _COUNTS_OF


def _responses(spark, d):
    return X.bound(spark, d, X.RESPONSES)


def _findings(spark, d):
    rows = _responses(spark, d).select("conv_id", "turn", "role", "response", F.lit("x").alias("unit_key"))
    return normalize.explode_findings(rows)


def sanitize_json(spark, d):
    return _responses(spark, d).select("conv_id", "turn", A.clean_json(F.col("response")).alias("clean"))


def findings_explode(spark, d):
    return _findings(spark, d).select("conv_id", "turn", (F.col("pos") - 1).cast("long").alias("pos"), "category", "verifiable", F.col("metadata.expression").alias("expression"))


def finding_defaults(spark, d):
    f = _findings(spark, d)
    return normalize.with_defaults(f).select("conv_id", "turn", "id", "stage", "finding_type", "confidence", F.col("line").cast("long").alias("line"), F.size("evidence").cast("long").alias("evidence"))


def unique_ids(spark, d):
    f = _findings(spark, d).withColumn("id", A.or_default(F.col("id"), "unknown"))
    unit = Window.partitionBy("conv_id").orderBy("turn")
    again = F.row_number().over(Window.partitionBy("conv_id", "id").orderBy("turn"))
    return f.select("conv_id", "turn", A.unique_id(F.col("id"), again, F.row_number().over(unit)).alias("id"))


def envelope_extract(spark, d):
    q = F.lit('"')
    rows = _responses(spark, d)
    content = F.concat(q, "role", F.lit(" "), F.col("turn").cast("string"), q)
    wrap = lambda head, tail: F.concat(F.lit(head), content, F.lit(tail))
    layouts = {0: wrap('{"output_text": ', "}"), 1: wrap('{"content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": ', "}]}"), 2: wrap('{"choices": [{"message": {"content": ', "}}]}"), 3: F.lit('{"choices": []}'), 4: wrap('{"output": [{"type": "reasoning", "content": []}, {"content": [{"type": "refusal", "text": "no"}, {"type": "output_text", "text": ', "}]}]}")}
    raw = F.coalesce(*[F.when(F.col("turn") % 5 == k, v) for k, v in layouts.items()])
    body = F.concat(F.lit('{"choices": [{"message": {"content": '), F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("body").alias("b"))).substr(F.lit(6), F.lit(1 << 20))).otherwise('""}'), F.lit("}]}"))
    return rows.select("conv_id", "turn", A.envelope_text(raw).alias("text"), F.size(A.chat_findings(body)).cast("long").alias("chat"))


def _units(spark, d):
    return flows.keyed_units(code.extract_units(X.bound(spark, d, X.UNITS)))


def _flow_inputs(spark, d):
    return _units(spark, d), X.bound(spark, d, X.UNIT_RESPONSES), X.bound(spark, d, X.UNIT_RUNS)


def normalize_rows(spark, d):
    units, responses, _ = _flow_inputs(spark, d)
    return normalize.analyzed(units, responses).select("path", "pos", "id", "rule", "finding_type", "category", "verifiable", "line", "relative_line", "has_guard", "ast_unrecognized", "original_category")


def flow_hybrid(spark, d):
    out = flows.hybrid(*_flow_inputs(spark, d))
    return out.select("file", "pos", "unit_name", "status", "final_class")


def flow_analyzer_only(spark, d):
    units, responses, _ = _flow_inputs(spark, d)
    return flows.analyzer_only(units, responses).groupBy("unit_name", "final_class").agg(F.count("*").alias("n"))


def flow_verifier_only(spark, d):
    units, _, runs = _flow_inputs(spark, d)
    _, files = flows.verifier_only(units.select(F.col("path").alias("file")).distinct(), units, runs)
    return files.select("file", "status", F.col("functions").cast("long").alias("functions"), F.array_join("violating", ",").alias("violating"), "summary")


def flow_benchmark(spark, d):
    units, _, runs = _flow_inputs(spark, d)
    cases, expected, answers = (X.bound(spark, d, s) for s in (X.FOUND_CASES, X.UNIT_EXPECTED, X.UNIT_ATTEMPTS))
    counts, _ = flows.benchmark(cases, expected, units, answers, runs)
    return evaluation.totals(counts)


def flow_benchmark_categories(spark, d):
    units, _, runs = _flow_inputs(spark, d)
    cases, expected, answers = (X.bound(spark, d, s) for s in (X.FOUND_CASES, X.UNIT_EXPECTED, X.UNIT_ATTEMPTS))
    return flows.benchmark(cases, expected, units, answers, runs)[1]


def dead_letters(spark, d):
    units = lineage.cut(_units(spark, d))
    rows = attempts.placed(units, X.bound(spark, d, X.UNIT_ATTEMPTS))
    return attempts.dead_letters(rows, attempts.outcomes(units, rows)).select("file", "unit_key", "attempt", "error", "response", "lost")


def attempt_outcomes(spark, d):
    units = lineage.cut(_units(spark, d))
    return attempts.outcomes(units, attempts.placed(units, X.bound(spark, d, X.UNIT_ATTEMPTS)))


def odd_payloads(spark, d):
    f = normalize.with_defaults(normalize.explode_findings(X.bound(spark, d, X.ODD_RESPONSES)))
    return f.select("conv_id", "turn", "id", "stage", "explanation", F.array_join("evidence", "|").alias("evidence"), "verifiable", "expression", "line", "expected_exception")


def guard_cover(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    i = F.col("l_linenumber") % 4
    expression = F.when(i == 0, F.concat(F.lit("total // "), "l_returnflag")).when(i == 1, F.concat(F.lit("x / "), "l_returnflag")).when(i == 2, F.concat(F.lit("a["), "l_linestatus", F.lit("]"))).otherwise("f(x)")
    category = F.when(i <= 1, "division_by_zero").when(i == 2, "out_of_bounds").otherwise("assertion_violation")
    guards = F.array(F.lit("R != 0"), F.lit("A > 1"), F.concat(F.lit("len > "), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linestatus")).otherwise("q")))
    return rows.groupBy(category.alias("category"), expression.alias("expression"), A.guard_covers(category, expression, guards).alias("covered")).agg(F.count("*").alias("n"))


def backend_infer(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source")
    k = F.col("doc_id") % 7
    model = F.when(k == 0, F.concat(F.lit("GPT-4o mini/"), "source")).when(k == 1, F.concat(F.lit("claude x "), "source")).when(k == 2, F.concat(F.lit("Gemini:"), "source")).when(k == 3, F.concat(F.lit("__qwen."), "source")).when(k == 4, "azure/o4-mini").when(k == 5, "DeepSeek")
    return rows.groupBy(model.alias("model"), A.backend_of(model).alias("backend"), A.safe_name(model).alias("name"), A.short_name(model).alias("short"), A.resolve_model(model, A.backend_of(model)).alias("resolved")).agg(F.count("*").alias("n"))


def escapes(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet")
    return rows.select("page_id", F.md5(A.escape_html(F.col("html"))).alias("html"), F.md5(A.escape_script(F.col("html"))).alias("script"))


def _shapes(spark, d):
    rows = X.bound(spark, d, X.EXPECTED)
    n = F.col("case_id")
    issues = lint.shape_issues(F.col("category"), F.col("verifiable"), F.col("verifiable") & (n % 7 != 0), F.when(F.col("verifiable") & (n % 5 != 0), "x / y").otherwise(""), F.when(F.col("verifiable"), "Error").when(F.col("category") != "clean", F.when(n % 3 == 0, "smell").otherwise("odd")).otherwise("x"))
    return rows.withColumn("issues", issues)


def lint_shape(spark, d):
    return _shapes(spark, d).select("case_id", "category", F.array_join("issues", ",").alias("issues"))


def lint_counts(spark, d):
    return lint.counts(_shapes(spark, d))


def lint_near_line(spark, d):
    rows = spark.read.parquet(f"{d}/documents.parquet")
    word = F.regexp_extract("text", r"^(\S+)", 1)
    return rows.select("doc_id", lint.near_line(F.col("text"), word, (F.col("doc_id") % 4 + 1).cast("int")).alias("near"))


_R = f"r AS ({X.RESPONSES})"
# The clean form of every response is its body with JSON literals.
_CLEAN = "replace(body, 'True', 'true')"
_F = f"{_R}, j AS (SELECT *, {_CLEAN} AS clean, CASE turn % 4 WHEN 0 THEN 'assertion_violation' WHEN 1 THEN 'division_by_zero' WHEN 2 THEN 'long_method' ELSE 'naming' END AS category, turn % 2 = 0 AS verifiable FROM r)"
_MODEL = "CASE doc_id % 7 WHEN 0 THEN 'GPT-4o mini/' || source WHEN 1 THEN 'claude x ' || source WHEN 2 THEN 'Gemini:' || source WHEN 3 THEN '__qwen.' || source WHEN 4 THEN 'azure/o4-mini' WHEN 5 THEN 'DeepSeek' END"
# What the three units hold, written out by hand: unit, operations in order, guards, expressions and assertions.
_FACTS = """shapes AS (SELECT * FROM (VALUES (0, 'f'), (1, 'g'), (2, 'h')) t(shape, name)),
ops AS (SELECT * FROM (VALUES (0, 1, 'division', 'a // b', 3), (0, 2, 'division', 'a % 7', 4), (1, 1, 'call', 'len(rows)', 3), (1, 2, 'subscript', 'rows[i]', 4), (1, 3, 'division', 'rows[0] / i', 5), (1, 4, 'subscript', 'rows[0]', 5), (2, 1, 'call', 'range(n)', 2)) t(shape, ord, kind, expression, line)),
guards AS (SELECT * FROM (VALUES (0, 'b != 0'), (1, 'i >= 0'), (1, 'i < len(rows)')) t(shape, guard)),
executable AS (SELECT * FROM (VALUES (0, 'b != 0'), (0, 'a // b'), (0, 'a % 7'), (1, 'i >= 0'), (1, 'i < len(rows)'), (1, 'len(rows)'), (1, 'rows[i]'), (1, 'rows[0]'), (1, 'rows[0] / i'), (2, 'range(n)'), (2, 'n - k')) t(shape, expression)),
asserts AS (SELECT * FROM (VALUES (1, 'i >= 0')) t(shape, test)),
forms AS (SELECT * FROM (VALUES ('a // b', 'a // b', 'a // b', false, 'b'), ('a % 7', 'a % 7', 'a % 7', true, '7'), ('rows[i]', 'rows[i]', 'rows[i]', false, 'i'), ('len(rows)', 'len(rows)', 'len(rows)', false, NULL), ('assert i>=0', NULL, 'i >= 0', false, NULL), ('rows[0]/i', 'rows[0] / i', 'rows[0] / i', false, 'i'), ('a%7', 'a % 7', 'a % 7', true, '7'), ('k > 0', 'k > 0', 'k > 0', false, NULL)) t(expression, normal, assertion, constant, guarded_by))"""
_src = " ".join(f"WHEN {i} THEN {X._text(t)}" for i, t in enumerate(X.UNIT_SOURCES))
_told = " UNION ALL ".join(f"SELECT conv_id, turn, CAST({j + 1} AS INTEGER) AS pos, {X._given(j)} AS given, {X._pick(j, 0)} AS category, {X._pick(j, 1)} AS expression, {X._pick(j, 2)} = 'true' AS claimed FROM conversations" for j in range(3))
_NORMAL = f"""{_FACTS}, told AS ({_told}),
named AS (SELECT told.*, name, conv_id % 3 AS shape, {X._KEY} || '.py' AS path, CASE WHEN given = '' THEN 'unknown' WHEN trim(given) = '' THEN name || ':llm:' || CAST(pos AS VARCHAR) ELSE given END AS base FROM told JOIN shapes ON conv_id % 3 = shape),
seen AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY pos) AS k FROM named),
checked AS (SELECT seen.*, normal, coalesce(constant AND category = 'division_by_zero', false) AS constant, guarded_by,
    (SELECT min(ord) FROM ops o WHERE o.shape = seen.shape AND o.kind = CASE seen.category WHEN 'division_by_zero' THEN 'division' WHEN 'out_of_bounds' THEN 'subscript' END AND (seen.expression = '' OR o.expression = seen.expression)) AS op,
    EXISTS (SELECT 1 FROM executable x WHERE x.shape = seen.shape AND x.expression = normal) AS there,
    CASE WHEN seen.expression = '' THEN EXISTS (SELECT 1 FROM asserts a WHERE a.shape = seen.shape) ELSE contains(CASE seen.shape {_src} END, seen.expression) OR EXISTS (SELECT 1 FROM asserts a WHERE a.shape = seen.shape AND a.test = assertion) END AS asserted,
    EXISTS (SELECT 1 FROM guards g WHERE g.shape = seen.shape AND contains(g.guard, guarded_by)) AS guarded
  FROM seen LEFT JOIN forms ON forms.expression = seen.expression),
ruled AS (SELECT *, CASE WHEN category NOT IN ('assertion_violation', 'division_by_zero', 'out_of_bounds', 'long_method', 'many_parameters', 'complex_conditional') THEN 'N1' WHEN NOT claimed THEN 'N10'
    WHEN category = 'assertion_violation' THEN CASE WHEN asserted THEN 'N2' ELSE 'N3' END WHEN category NOT IN ('division_by_zero', 'out_of_bounds') THEN 'N4'
    WHEN op IS NOT NULL THEN CASE WHEN constant THEN 'N5' ELSE 'N6' END WHEN there THEN CASE WHEN constant THEN 'N7' ELSE 'N8' END ELSE 'N9' END AS rule FROM checked),
normal AS (SELECT path, pos, CASE WHEN k > 1 THEN base || ':' || CAST(pos AS VARCHAR) ELSE base END AS id, rule, category, name, conv_id, turn,
    CASE WHEN rule = 'N1' THEN 'out_of_scope_finding' WHEN rule IN ('N3', 'N5', 'N7', 'N9') THEN 'llm_false_positive' WHEN rule = 'N4' THEN 'smell_heuristic' ELSE 'suspected_bug' END AS finding_type, rule IN ('N2', 'N6', 'N8') AS verifiable,
    CASE WHEN rule IN ('N5', 'N6') THEN (SELECT line FROM ops o WHERE o.shape = ruled.shape AND o.ord = op) ELSE 1 END AS line, CASE WHEN rule IN ('N5', 'N6') THEN (SELECT line FROM ops o WHERE o.shape = ruled.shape AND o.ord = op) ELSE 0 END AS relative_line,
    CASE WHEN rule = 'N6' THEN CASE WHEN guarded THEN 'true' ELSE 'false' END WHEN rule NOT IN ('N4', 'N10') THEN 'false' END AS has_guard, CASE WHEN rule = 'N8' THEN 'true' END AS ast_unrecognized, CASE WHEN rule = 'N1' THEN category END AS original_category FROM ruled)"""
# The run of a unit's function, by the row's number: two kinds of violation, a pass, a crash, and none.
_RUN = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'violation_found' WHEN 1 THEN 'violation_found' WHEN 2 THEN 'no_violation_found' WHEN 3 THEN 'tool_error' ELSE 'skipped' END"
_PROPERTY = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'division_by_zero' WHEN 1 THEN 'out_of_bounds' ELSE 'unknown_esbmc_violation' END"
_HYBRID = f"""{_NORMAL}, run AS (SELECT *, CASE WHEN verifiable THEN {_RUN} END AS status, {_PROPERTY} AS property FROM normal),
hybrid AS (SELECT *, CASE WHEN finding_type = 'smell_heuristic' THEN 'heuristic_smell_only' WHEN finding_type <> 'suspected_bug' THEN finding_type WHEN status IS NULL OR status = 'skipped' THEN 'skipped_not_verifiable'
    WHEN status = 'violation_found' AND property = category THEN 'llm_confirmed_by_esbmc' WHEN status = 'no_violation_found' THEN 'not_confirmed_within_bound' ELSE 'esbmc_inconclusive' END AS final_class FROM run)"""
_FILES = f"SELECT {X._KEY} || '.py' AS file, {_RUN} AS status, CAST(1 AS BIGINT) AS functions, CASE WHEN {_RUN} = 'violation_found' THEN name ELSE '' END AS violating FROM conversations JOIN (VALUES (0, 'f'), (1, 'g'), (2, 'h')) t(shape, name) ON conv_id % 3 = shape"
_CASED = f"""cases AS (SELECT case_id, '' AS model FROM ({X.UNIT_CASES}) c WHERE status = 'ok'), expected AS (SELECT e.* FROM ({X.UNIT_EXPECTED}) e WHERE case_id IN (SELECT case_id FROM cases)),
findings AS (SELECT conv_id * 1000 + turn AS case_id, name AS function, category, finding_type, verifiable, status, property FROM run WHERE conv_id * 1000 + turn IN (SELECT case_id FROM cases)),
direct AS (SELECT conv_id * 1000 + turn AS case_id, CASE conv_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' ELSE 'h' END AS function, {_RUN} AS status, {_PROPERTY} AS property FROM conversations WHERE conv_id * 1000 + turn IN (SELECT case_id FROM cases))"""
_LOST = f"SELECT count(*) FILTER (WHERE verifiable) AS bugs, count(*) FILTER (WHERE NOT verifiable AND category <> 'clean') AS smells, count(DISTINCT CASE WHEN verifiable THEN case_id END) AS cases FROM ({X.UNIT_EXPECTED}) e WHERE case_id IN (SELECT case_id FROM ({X.UNIT_CASES}) c WHERE status = 'missing')"
_ADDED = {"bug_fn": "bugs", "hybrid_fn": "bugs", "direct_fn": "bugs", "smell_fn": "smells", "func_fn": "cases", "hybrid_func_fn": "cases", "direct_func_fn": "cases"}
_BENCH = f"WITH {_HYBRID}, {_COUNTS_OF(_CASED)}, lost AS ({_LOST}) SELECT " + ", ".join(f"CAST(sum({c}) + any_value({_ADDED.get(c, '0')}) AS BIGINT) AS {c}" for c in evaluation.COUNTERS) + " FROM counts, lost"
_SHAPE = f"""e AS ({X.EXPECTED}), s AS (SELECT case_id, category, concat_ws(',', CASE WHEN verifiable AND case_id % 7 = 0 THEN 'should_go_to_esbmc' END, CASE WHEN verifiable AND case_id % 5 = 0 THEN 'expression' END,
  CASE WHEN NOT verifiable AND category <> 'clean' AND case_id % 3 <> 0 THEN 'expected_type' END) AS issues FROM e)"""
_LETTERS = f"SELECT conv_id, attempt, unit_key, response, split_part(unit_key, '::', 1) AS file FROM (SELECT a.*, CAST(split_part(unit_key, ':', 1) AS BIGINT) AS conv_id FROM ({X.UNIT_ATTEMPTS}) a) b"
_ODD = f"o AS ({X.ODD_RESPONSES}), j AS (SELECT conv_id, turn, json_extract(response, '$.findings[0]') AS f FROM o)"


def _json_truth(path: str) -> str:
    j = f"json_extract(f, '$.{path}')"
    return f"coalesce(CASE json_type({j}) WHEN 'BOOLEAN' THEN {j} = 'true' WHEN 'VARCHAR' THEN {j} ->> '$' <> '' WHEN 'ARRAY' THEN json_array_length({j}) > 0 WHEN 'OBJECT' THEN len(json_keys({j})) > 0 WHEN 'NULL' THEN false ELSE CAST({j} AS DOUBLE) <> 0 END, false)"


def _json_text(j: str) -> str:
    return f"CASE json_type({j}) WHEN 'NULL' THEN 'None' WHEN 'BOOLEAN' THEN CASE WHEN {j} = 'true' THEN 'True' ELSE 'False' END WHEN 'VARCHAR' THEN {j} ->> '$' ELSE CAST({j} AS VARCHAR) END"


def _json_said(path: str, default: str) -> str:
    return f"CASE WHEN {_json_truth(path)} THEN {_json_text(f"json_extract(f, '$.{path}')")} ELSE '{default}' END"


_line = "json_extract(f, '$.metadata.line')"
_evidence = "json_extract(f, '$.evidence')"
_ODD_SQL = f"""WITH {_ODD} SELECT conv_id, turn, {_json_said('id', 'unknown')} AS id, 's' AS stage, {_json_said('explanation', '')} AS explanation, {_json_truth('verifiable')} AS verifiable,
  CASE WHEN {_evidence} IS NULL THEN '' WHEN json_type({_evidence}) = 'ARRAY' THEN coalesce(array_to_string([coalesce({_json_text('x')}, 'None') FOR x IN CAST({_evidence} AS JSON[])], '|'), '') ELSE {_json_text(_evidence)} END AS evidence,
  coalesce({_json_text("json_extract(f, '$.metadata.expression')")}, '') AS expression, coalesce({_json_text("json_extract(f, '$.expected_exception')")}, '') AS expected_exception,
  coalesce(CASE json_type({_line}) WHEN 'BOOLEAN' THEN CASE WHEN {_line} = 'true' THEN 1 ELSE 0 END WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim({_line} ->> '$'), '-?[0-9]+') THEN CAST(trim({_line} ->> '$') AS INTEGER) END WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN NULL ELSE CAST(trunc(CAST({_line} AS DOUBLE)) AS INTEGER) END, 0) AS line
FROM j"""

PLANS = {
    "q_sanitize_json": (sanitize_json, f"WITH {_F} SELECT conv_id, turn, clean FROM j"),
    "q_findings_explode": (findings_explode, f"WITH {_F} SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, category, verifiable, role || ' / 4' AS expression FROM j"),
    "q_finding_defaults": (finding_defaults, f"WITH {_F} SELECT conv_id, turn, CASE WHEN raw_id = '' THEN 'unknown' ELSE raw_id END AS id, 'llm_analysis' AS stage, 'smell_heuristic' AS finding_type, 'low' AS confidence, CASE WHEN turn % 5 = 0 THEN 0 ELSE turn END AS line, CAST(0 AS BIGINT) AS evidence FROM j"),
    "q_unique_ids": (unique_ids, f"WITH {_F}, u AS (SELECT conv_id, turn, CASE WHEN raw_id = '' THEN 'unknown' ELSE raw_id END AS id FROM j), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, id ORDER BY turn) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM u) SELECT conv_id, turn, CASE WHEN k > 1 THEN id || ':' || CAST(pos AS VARCHAR) ELSE id END AS id FROM n"),
    "q_envelope_extract": (envelope_extract, f"WITH {_R} SELECT conv_id, turn, CASE WHEN turn % 5 <> 3 THEN role || ' ' || CAST(turn AS VARCHAR) END AS text, CAST(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS chat FROM r"),
    "q_normalize": (normalize_rows, f"WITH {_NORMAL} SELECT path, pos, id, rule, finding_type, category, verifiable, line, relative_line, has_guard, ast_unrecognized, original_category FROM normal"),
    "q_flow_hybrid": (flow_hybrid, f"WITH {_HYBRID} SELECT path AS file, pos, name AS unit_name, status, final_class FROM hybrid"),
    "q_flow_analyzer_only": (flow_analyzer_only, f"WITH {_NORMAL} SELECT name AS unit_name, CASE finding_type WHEN 'smell_heuristic' THEN 'heuristic_smell_only' WHEN 'suspected_bug' THEN 'llm_only_suspected' ELSE finding_type END AS final_class, count(*) AS n FROM normal GROUP BY 1, 2"),
    "q_flow_verifier_only": (flow_verifier_only, f"WITH f AS ({_FILES}) SELECT *, CASE status WHEN 'violation_found' THEN 'violated in ' || violating WHEN 'no_violation_found' THEN '1 functions without violation within the bound' WHEN 'skipped' THEN 'not run: no verifier, or no function' ELSE 'the verifier failed on every function' END AS summary FROM f"),
    "q_flow_benchmark": (flow_benchmark, _BENCH),
    "q_flow_benchmark_categories": (flow_benchmark_categories, f"WITH {_HYBRID}, {_COUNTS_OF(_CASED)}, {_CATEGORY_SQL}"),
    "q_dead_letters": (dead_letters, f"WITH l AS ({_LETTERS}) SELECT file, unit_key, attempt, CASE WHEN response IS NULL THEN 'no answer' ELSE 'no findings list in the response' END AS error, response, conv_id % 13 = 12 AS lost FROM l WHERE response IS NULL OR NOT starts_with(response, '<think>')"),
    "q_attempt_outcomes": (attempt_outcomes, f"WITH l AS ({_LETTERS}) SELECT file, min(attempt) FILTER (WHERE starts_with(response, '<think>')) AS attempt, CAST(count(*) AS INTEGER) AS attempts FROM l GROUP BY file"),
    "q_odd_payloads": (odd_payloads, _ODD_SQL),
    "q_guard_cover": (guard_cover, "WITH x AS (SELECT l_linenumber % 4 AS i, l_returnflag AS f, l_linestatus AS s, l_orderkey % 2 = 0 AS even FROM lineitem), y AS (SELECT CASE WHEN i <= 1 THEN 'division_by_zero' WHEN i = 2 THEN 'out_of_bounds' ELSE 'assertion_violation' END AS category, CASE i WHEN 0 THEN 'total // ' || f WHEN 1 THEN 'x / ' || f WHEN 2 THEN 'a[' || s || ']' ELSE 'f(x)' END AS expression, CASE WHEN i <= 1 THEN f IN ('R', 'A') OR (even AND f = s) WHEN i = 2 THEN even ELSE false END AS covered FROM x) SELECT category, expression, covered, count(*) AS n FROM y GROUP BY ALL"),
    "q_backend_infer": (backend_infer, f"WITH m AS (SELECT {_MODEL} AS model FROM documents), b AS (SELECT *, CASE WHEN model IS NULL THEN 'openai' WHEN contains(lower(model), 'claude') THEN 'anthropic' WHEN contains(lower(model), 'gemini') THEN 'google' WHEN regexp_matches(lower(model), 'gpt|o1|o3|o4') THEN 'openai' ELSE 'ollama' END AS backend FROM m) SELECT model, backend, trim(regexp_replace(model, '[^A-Za-z0-9_-]', '_', 'g'), '_') AS name, string_split(model, '/')[-1] AS short, CASE WHEN model IS NULL THEN 'gpt-4o' WHEN lower(model) = 'deepseek' THEN 'deepseek-r1:7b' ELSE model END AS resolved, count(*) AS n FROM b GROUP BY 1, 2, 3, 4, 5"),
    "q_escapes": (escapes, "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS html, md5(replace(html, '</', '<\\/')) AS script FROM pages"),
    "q_lint_shape": (lint_shape, f"WITH {_SHAPE} SELECT case_id, category, issues FROM s"),
    "q_lint_counts": (lint_counts, f"WITH {_SHAPE} SELECT category, count(*) AS items, count(*) FILTER (WHERE issues <> '') AS failures FROM s GROUP BY category"),
    "q_lint_near_line": (lint_near_line, "WITH l AS (SELECT doc_id, CAST(doc_id % 4 + 1 AS BIGINT) AS line, string_split(text, chr(10)) AS a, lower(regexp_extract(text, '^(\\S+)', 1)) AS word FROM documents) SELECT doc_id, len(list_filter(list_slice(a, greatest(line - 1, 1), line + 1), lambda x: contains(lower(replace(x, ' ', '')), word))) > 0 AS near FROM l"),
}
