"""Column expressions over verifier output, responses and sources."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from verdictflow.functions import findings as A
from verdictflow.functions import prompts
from verdictflow.functions import verifier as V
from verdictflow.operators import attempts, flows, jobs, lint, normalize
from verdictflow.sources import analyzers, code, ground_truth

AV, DZ, OOB = V.FORMAL


def one(spark, column, **values):
    return spark.range(1).select(column(*[F.lit(v) for v in values.values()])).first()[0]


@pytest.mark.parametrize(("out", "code_", "want"), [("VERIFICATION FAILED", 1, "violation_found"), ("Verification Successful", 1, "no_violation_found"), ("av_violation.py", 0, "no_violation_found"), ("av_violation.py", 1, "inconclusive"), ("", 0, "no_violation_found"), ("", 1, "inconclusive"), ("ERROR: x", 0, "tool_error"), ("ERROR: x\nVERIFICATION FAILED", 0, "violation_found"), (None, None, "skipped")])
def test_function_status(spark, out, code_, want):
    assert one(spark, lambda o, c: V.function_status(o.cast("string"), c.cast("int")), o=out, c=code_) == want


@pytest.mark.parametrize(("out", "want"), [("Generated 0 VCC(s)\nVERIFICATION SUCCESSFUL", "no_vcc_generated"), ("generated 12 VCCs\nVERIFICATION SUCCESSFUL", "no_violation_found"), ("ERROR: Cannot open file a", "unsupported_case"), ("ERROR: Not Supported", "unsupported_case"), ("ERROR: other", "tool_error"), ("Generated 0 VCC(s)\nVERIFICATION FAILED", "violation_found")])
def test_module_status(spark, out, want):
    assert one(spark, lambda o: V.module_status(o, F.lit(0)), o=out) == want


def test_property_block(spark):
    out = "State 1 file a.py line 3 column 2 function g thread 0\n x=1 (0x1)\nl = 3\nx =  1 (0x9)\n" + "".join(f"v{i} = {i}\n" for i in range(9)) + "\nViolated property:\n  file a.py line 9 function f\n  assertion\n  x > 0\n  file b.py line 1 function late\n\nVERIFICATION FAILED\n"
    p = one(spark, V.property_parts, o=out)
    assert (p.kind, p.text, p.function, p.line) == ("assertion", "x > 0", "f", 9)
    assert one(spark, V.counterexample, o=out) == ["x = 1", "v0 = 0", "v1 = 1", "v2 = 2", "v3 = 3", "v4 = 4"]
    q = one(spark, V.property_parts, o=out.split("\nViolated")[0])
    assert (q.kind, q.function, q.line) == (None, "g", 3)
    bare = one(spark, V.property_parts, o="Violated property:\n  array bounds violated")
    assert (bare.kind, bare.text) == ("array bounds violated", None)
    assert one(spark, V.warnings, o="a SyntaxWarning: x\nSyntaxWarning: x\nSyntaxWarning:  \nb") == ["x"]
    other = one(spark, lambda o: V.property_parts(o, F.lit("b.py")), o="State 1 file a.py line 3 column 2 function g thread 0\nState 2 file b.py line 5 column 1 thread 0\n")
    assert (other.function, other.line) == (None, 5)
    split = one(spark, V.property_parts, o="State 1 line 3 column 2 function g thread 0\nState 2 line 8 column 2 thread 0\nState 3 line 9 function h\n")
    assert (split.function, split.line) == ("g", 8)
    assert one(spark, V.counterexample, o="  a=b = 2\nc == 3\n1x = 2\nitem=4\n") == ["a = b = 2", "c = = 3"]


@pytest.mark.parametrize(("out", "status", "word"), [("Dereference failure: division by zero", "inconclusive", "dereference"), ("division by zero, assertion", "FAILED", "div-by-zero"), ("assertion\nVERIFICATION FAILED", "FAILED", "assertion"), ("an assertion\nVERIFICATION SUCCESSFUL", "SUCCESSFUL", ""), ("ok\n  Crash: " + "x" * 40, "inconclusive", "Crash: " + "x" * 23), ("array bounds", "inconclusive", "")])
def test_sweep_keyword(spark, out, status, word):
    assert one(spark, V.keyword, o=out, s=status) == word
    assert one(spark, V.sweep_status, o=out) in (status, "inconclusive")


def test_sweep_tally(spark):
    rows = spark.createDataFrame([("clean", "f", "SUCCESSFUL"), ("clean", "f", "timeout"), ("clean", None, None), ("out_of_bounds", "f", "FAILED"), ("out_of_bounds", "f", "inconclusive")], "category string, function string, sweep_status string")
    assert {r.category: (r.ok, r.fail, r.skip, r.total) for r in jobs.sweep_tally(rows).collect()} == {"clean": (1, 1, 1, 3), "out_of_bounds": (1, 1, 0, 2)}


@pytest.mark.parametrize(("text", "want"), [("Assertion of division by zero", "assertion_violation"), ("DIVISION BY ZERO", "division_by_zero"), ("bad divisor", "division_by_zero"), ("array out-of-bounds", "out_of_bounds"), ("dereference failure", "out_of_bounds"), ("IndexError", "out_of_bounds"), ("ZeroDivisionError", "division_by_zero"), ("leak", "unknown_esbmc_violation"), (None, "unknown_esbmc_violation")])
def test_property_category(spark, text, want):
    assert one(spark, lambda t: V.property_category(t.cast("string")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [(' {"findings": []} ', '{"findings": []}'), ('<think>no\nyes</think>{"a": True}', '{"a": true}'), ('```json\n{"a": None, "b": "None"}\n```', '{"a": null, "b": "null"}'), ('```\n{"a": False}\n``` ', '{"a": false}'), ("Trueish", "Trueish"), ('{"a": "}\\"{"} and {more}', '{"a": "}\\"{"}'), ("```json\n[1]\n```\nSo it is.", "[1]"), ("{bad} more", "{bad} more"), ("null and void", "null"), ("", "")])
def test_clean_json(spark, text, want):
    assert one(spark, A.clean_json, t=text) == want


def test_responses(spark):
    found = one(spark, A.parse_response, t='```json\n{"findings": [{"id": "a", "verifiable": True, "evidence": ["x", "y"], "metadata": {"line": "7"}}]}\n``` ')
    assert found[0].id == "a" and found[0].verifiable and found[0].metadata.line == "7"
    assert one(spark, A.parse_response, t='{"findings": []} and more') == []
    assert one(spark, A.parse_response, t="no json") is None
    assert [one(spark, lambda t: A.evidence_list(F.try_parse_json(t.cast("string"))), t=x) for x in ('["x", 1, null, true, {"a": [2]}]', '"plain"', None, '"[odd"', "null", "7")] == [["x", "1", "None", "True", '{"a":[2]}'], ["plain"], [], ["[odd"], ["None"], ["7"]]
    assert [one(spark, A.safe_int, t=x) for x in ("7", "", "x")] == [7, 0, 0]


@pytest.mark.parametrize(("category", "expression", "guards", "want"), [("division_by_zero", "a // b", ["b != 0"], True), ("division_by_zero", "a / b", ["c"], False), ("division_by_zero", "a", ["a"], False), ("out_of_bounds", "m[i][j]", ["i][j < 3"], True), ("out_of_bounds", "m[i]", [], False), ("assertion_violation", "b", ["b"], False)])
def test_guards(spark, category, expression, guards, want):
    column = A.guard_covers(F.lit(category), F.lit(expression), F.array(*[F.lit(g) for g in guards]).cast("array<string>"))
    assert spark.range(1).select(column).first()[0] is want


@pytest.mark.parametrize(("row", "want"), [(("odd", True, True, True, True, True), "N1 out_of_scope_finding False"), (("assertion_violation", True, True, False, False, False), "N2 suspected_bug True"), (("assertion_violation", True, False, True, True, False), "N3 llm_false_positive False"), (("long_method", True, True, True, True, False), "N4 smell_heuristic False"), (("division_by_zero", True, False, True, True, True), "N5 llm_false_positive False"), (("division_by_zero", True, False, True, True, False), "N6 suspected_bug True"), (("division_by_zero", True, False, False, True, True), "N7 llm_false_positive False"), (("out_of_bounds", True, False, False, True, False), "N8 suspected_bug True"), (("out_of_bounds", True, True, False, False, False), "N9 llm_false_positive False"), (("out_of_bounds", False, True, True, True, True), "N10 given False")])
def test_normal_form(spark, row, want):
    c, *flags = row
    got = spark.range(1).select(A.normal_form(F.lit("given"), F.lit(c), *[F.lit(f) for f in flags])).first()[0]
    assert f"{got.rule} {got.finding_type} {got.verifiable}" == want


def test_rollup_and_jobs(spark):
    runs = spark.createDataFrame([("a", "f", 1, "no_violation_found"), ("a", "g", 0, "violation_found"), ("a", "e", 2, "violation_found"), ("b", "f", 0, "tool_error"), ("c", "f", 0, "skipped"), ("d", "f", 0, "tool_error"), ("d", "g", 1, "inconclusive")], "file string, function string, ord int, status string")
    files = spark.createDataFrame([(x,) for x in "abcde"], "file string")
    got = {r.file: (r.status, r.violating) for r in jobs.file_rollup(files, runs).collect()}
    assert got == {"a": ("violation_found", ["g", "e"]), "b": ("tool_error", []), "c": ("skipped", []), "d": ("inconclusive", []), "e": ("skipped", [])}
    plan = jobs.plan_jobs(runs.withColumn("verifiable", F.col("ord") == 0), runs.where("file = 'a'")).collect()
    assert len(plan) == 6 and all(r.command[:2] == ["esbmc", "--function"] for r in plan)


ENVELOPES = [
    ('{"output_text": "a"}', "a"), ('{"output": [{"type": "reasoning"}, {"content": [{"type": "refusal", "text": "no"}, {"type": "text", "text": "b"}]}]}', "b"),
    ('{"content": [{"type": "thinking", "thinking": "no"}, {"type": "text", "text": "c"}]}', "c"), ('{"choices": [{"message": {"content": "d"}}]}', "d"), ('{"choices": []}', None), ("odd", None),
]


@pytest.mark.parametrize(("raw", "want"), ENVELOPES)
def test_envelopes(spark, raw, want):
    assert one(spark, A.envelope_text, t=raw) == want
    assert one(spark, A.chat_findings, t=raw) == []


@pytest.mark.parametrize(("model", "want"), [("o4-mini", "openai gpt-4o o4-mini o4-mini"), ("azure/o1", "openai azure_o1 o1 azure/o1"), (None, "openai None None gpt-4o"), ("Claude", "anthropic Claude Claude claude-3-7-sonnet-20250219"), ("deepseek", "ollama deepseek DeepSeek-R1 Distill-Qwen-7B deepseek-r1:7b"), ("..", "ollama model .. .."), ("x/gpt-4o", "openai x_gpt-4o GPT-4o x/gpt-4o")])
def test_model_names(spark, model, want):
    m = F.lit(model).cast("string")
    got = spark.range(1).select(A.backend_of(m), A.safe_name(m), A.short_name(m), A.resolve_model(m, A.backend_of(m))).first()
    backend, rest = want.split(" ", 1)
    assert got[0] == backend and (model == "o4-mini" or f"{got[1]} {got[2]} {got[3]}" == rest)


def test_numbers_as_text(spark):
    assert [one(spark, lambda v: A.fixed(v.cast("double")), v=x) for x in (0.5, None)] == ["0.5000", "N/A"]


def test_units():
    text = "class A:\n    def main(self, *a, k=1):\n        x: list[int] = a[0]\n        return x\n\nasync def f(p: int, /, q) -> int:\n    async for z in q:\n        pass\n    return p % q\n\ndef test_x():\n    def inner():\n        pass\n\ndef main():\n    pass\n"
    rows = list(code.units_of(text))
    assert [r[2] for r in rows] == ["A.main", "f"]
    assert [o[1] for o in rows[0][8]] == ["a[0]"] and rows[1][6] == ["q"] and rows[1][7] == {"return": "int"} and rows[1][9] == []
    assert list(code.units_of("def (")) == [] and code.facts_of("def (")[0] is False
    spaced = next(code.units_of("def f(a,b):\n    if  b!=0 :\n        while a :\n            a=a-1\n    assert(a<b)\n"))
    assert spaced[10] == ["b != 0"] and spaced[11] == ["b != 0", "a < b"] and spaced[9] == ["while a :\n            a=a-1"]
    assert next(code.units_of("@deco(1 / 2)\ndef f(a=x[0]):\n    pass\n"))[8] == []


def test_expressions():
    assert code.normal_expression("a>0") == "a > 0" and code.normal_expression("assert a>0") is None and code.normal_expression(" ") is None and code.normal_expression(None) is None
    assert code.normal_assertion("assert a>0") == "a > 0" == code.normal_assertion(" a>0 ") and code.normal_assertion("x = 1") is None and code.normal_assertion("a; b") is None
    known = {"x / 2": True, "x // 1_000": True, "x % 0x10": True, "x / 1e3": True, "x / 0": False, "x / -1": False, "a + b / 2": False, "f(a / 2": False, "x * 2": False, "": False}
    assert {t: code.constant_divisor(t) for t in known} == known
    unit = next(code.units_of("def f(a: list[int] = x[0]) -> int:\n    # hidden(a)\n    return 'quoted(a)' and g(a)\n"))
    assert {"list[int]", "x[0]", "g(a)"} <= set(unit[13]) and not any("hidden" in e or "quoted(a)" == e for e in unit[13])


def test_normalized_findings(spark):
    """One finding for each rule, against real source, with ids that repeat or are blank."""
    source = "def f(a, b):\n    if b!=0:\n        return a / b\n    assert a>0\n    return a[b] // 4\n"
    units = flows.keyed_units(code.extract_units(spark.createDataFrame([("x.py", source)], "path string, text string")))
    told = [
        ("a", DZ, "a / b", True, "N6 suspected_bug True 3 true"), ("a", DZ, "a[b] // 4", True, "N5 llm_false_positive False 5 false"), ("  ", OOB, "a[b]", True, "N6 suspected_bug True 5 true"), ("", AV, "assert a > 0", True, "N2 suspected_bug True 0 false"),
        ("b", AV, "", True, "N2 suspected_bug True 0 false"), ("b", AV, "a < 9", True, "N3 llm_false_positive False 0 false"), ("c", "naming", "x", True, "N1 out_of_scope_finding False 0 false"), ("c", "long_method", "x", True, "N4 smell_heuristic False 0 None"),
        ("d", OOB, "b != 0", True, "N8 suspected_bug True 0 false"), ("d", DZ, "q / r", True, "N9 llm_false_positive False 0 false"), ("e", DZ, "a[b]//4", True, "N7 llm_false_positive False 0 false"), ("f", DZ, "a / b", False, "N10 suspected_bug False 0 None"),
    ]
    body = {"findings": [{"id": i, "finding_type": "suspected_bug", "category": c, "verifiable": v, "evidence": "e", "metadata": {"expression": e, "line": "x"}} for i, c, e, v, _ in told]}
    responses = spark.createDataFrame([("x.py::0::f", "```json\n" + json.dumps(body) + "\n```"), ("x.py::0::f2", '{"findings": {}}')], "unit_key string, response string")
    got = {r.pos: r for r in normalize.analyzed(units, responses).collect()}
    assert {p: f"{r.rule} {r.finding_type} {r.verifiable} {r.line} {r.has_guard}" for p, r in got.items()} == {i + 1: t[4] for i, t in enumerate(told)}
    assert [got[i + 1].id for i in range(12)] == ["a", "a:2", "f:llm:3", "unknown", "b", "b:6", "c", "c:8", "d", "d:10", "e", "f"]
    assert got[9].ast_unrecognized == "true" and got[7].original_category == "naming" and got[1].evidence == ["e"]
    errors = normalize.explode_findings(responses).where("error is not null").collect()
    assert [r.unit_key for r in errors] == ["x.py::0::f2"] and errors[0].pos is None


def test_flows(spark):
    """The evaluator's scenarios in one piece: an analyzer that is replayed, a recorded verifier, and ground truth."""
    text = "def f(a, b):\n    return a / b\n"
    files = spark.createDataFrame([(p, text) for p in ("bug.py", "clean.py", "missed.py", "none.py")], "path string, text string")
    units = flows.keyed_units(code.extract_units(files))
    finding = {"id": "1", "finding_type": "suspected_bug", "category": DZ, "verifiable": True, "metadata": {"expression": "a / b"}}
    ghost = {"id": "2", "category": DZ, "verifiable": True, "metadata": {"expression": "q / r"}}
    answers = [("bug.py::0::f", json.dumps({"findings": [finding, ghost]})), ("clean.py::0::f", json.dumps({"findings": [finding]})), ("missed.py::0::f", '{"findings": []}')]
    responses = spark.createDataFrame(answers, "unit_key string, response string")
    failed = "Violated property:\n  file x line 2 column 1 function f\n  division by zero\n  b != 0\n\nVERIFICATION FAILED"
    runs = spark.createDataFrame([("bug.py", "f", failed, 1), ("clean.py", "f", "VERIFICATION SUCCESSFUL", 0), ("missed.py", "f", failed, 1)], "file string, function string, stdout string, returncode int")
    final = {(r.file, r.pos): (r.final_class, r.location) for r in flows.hybrid(units, responses, runs).collect()}
    assert final == {("bug.py", 1): ("llm_confirmed_by_esbmc", "f, line 2"), ("bug.py", 2): ("llm_false_positive", None), ("clean.py", 1): ("not_confirmed_within_bound", "")}
    assert {r.final_class for r in flows.analyzer_only(units, responses).collect()} == {"llm_only_suspected", "llm_false_positive"}
    _, rolled = flows.verifier_only(units.select(F.col("path").alias("file")), units, runs)
    assert {r.file: r.status for r in rolled.collect()} == {"bug.py": "violation_found", "clean.py": "no_violation_found", "missed.py": "violation_found", "none.py": "skipped"}
    cases = spark.createDataFrame([(1, "bug.py", "ok"), (2, "clean.py", "ok"), (3, "missed.py", "ok"), (4, "gone.py", "missing"), (5, "none.py", "failed")], "case_id long, file string, status string")
    expected = spark.createDataFrame([(1, "f", DZ, True), (2, "f", "clean", False), (3, "f", DZ, True), (4, "f", DZ, True), (5, "f", DZ, True)], "case_id long, function string, category string, verifiable boolean")
    counts, categories = flows.benchmark(cases, expected, units, responses, runs)
    got = {r.case_id: r for r in counts.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].bug_tp, got[1].bug_fp, got[1].hybrid_tp, got[1].hallucinations, got[1].direct_tp, got[1].missed_by_analyzer) == (1, 1, 1, 1, 1, 0)
    assert (got[2].bug_fp, got[2].func_fp, got[2].hybrid_func_tn, got[2].direct_func_tn) == (1, 1, 1, 1)
    assert (got[3].bug_fn, got[3].native_bugs, got[3].missed_by_analyzer) == (1, 1, 1) and (got[4].bug_fn, got[4].func_fn, got[4].direct_fn) == (1, 1, 1)
    assert {(r.flow, r.category): (r.tp, r.fp, r.fn) for r in categories.collect()} == {("llm", DZ): (1, 2, 1), ("hybrid", DZ): (1, 0, 1)}


def test_fields_of_any_type(spark):
    """Texts, numbers and truth values as Python would take them from a JSON value."""
    values = ["yes", "false", "", 0, 1, 0.0, -2.9, True, False, None, [], [0], {}, {"a": 1}, "7", " 8 ", "7.5"]
    rows = [(i, json.dumps({"findings": [{"verifiable": v, "id": v, "expected_exception": v, "metadata": {"line": v, "expression": v}}]})) for i, v in enumerate(values)]
    rows += [(90, json.dumps({"findings": [{"metadata": [1], "evidence": None}, 7]})), (91, '{"findings": 5}'), (92, "[1]"), (93, None)]
    parsed = spark.createDataFrame(rows, "unit_key long, response string")
    got = {(r.unit_key, r.pos): r for r in normalize.with_defaults(normalize.explode_findings(parsed)).collect()}

    def whole(v):
        try:
            return int(v) if v not in (None, "") else 0
        except (TypeError, ValueError):
            return 0

    said = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, (list, dict)) else "0" if v == 0 and not isinstance(v, bool) else str(v)
    for i, v in enumerate(values):
        r = got[i, 1]
        assert (r.verifiable, r.id, r.line, r.expression, r.expected_exception) == (bool(v), said(v) if v else "unknown", whole(v), said(v), said(v)), v
    assert (got[90, 1].evidence, got[90, 1].expression, got[90, 1].line, got[90, 2].category) == (["None"], "", 0, "unknown")
    assert set(got) == {(i, 1) for i in range(len(values))} | {(90, 1), (90, 2)}


def test_attempts(spark):
    """The first attempt whose every answer can be read counts; a file without one is lost."""
    text = "def f(a, b):\n    return a / b\n\ndef g(a):\n    return a\n"
    units = flows.keyed_units(code.extract_units(spark.createDataFrame([(p, text) for p in ("a.py", "b.py", "c.py", "d.py", "e.py")] + [("empty.py", "x = 1\n")], "path string, text string"))).cache()
    none, good = '{"findings": []}', json.dumps({"findings": [{"id": "1", "finding_type": "suspected_bug", "category": DZ, "verifiable": True, "metadata": {"expression": "a / b"}}]})
    f, g = lambda p: f"{p}::0::f", lambda p: f"{p}::1::g"
    rows = [
        (f("a.py"), 1, good, None, None), (g("a.py"), 1, "cut off {", None, None), (f("a.py"), 2, none, None, None), (g("a.py"), 2, none, None, None),  # what the first attempt found does not count
        (f("b.py"), 1, good, None, None), (f("b.py"), 2, good, None, None), (g("b.py"), 2, none, "timeout", None), (f("b.py"), 3, None, None, None),  # no attempt is whole
        (f("c.py"), 1, "", None, True), (g("c.py"), 1, good, None, True),  # the chat layout
        (f("d.py"), 3, "", None, False), (g("d.py"), 3, none, None, False), (f("d.py"), 4, good, None, None), (g("d.py"), 4, good, None, None),  # tried too often
        (f("gone.py"), 1, good, None, None),
    ]
    answers = spark.createDataFrame(rows, "unit_key string, attempt int, response string, error string, chat boolean")
    placed = attempts.placed(units, answers)
    ended = attempts.outcomes(units, placed)
    assert {r.file: (r.attempt, r.attempts) for r in ended.collect()} == {"a.py": (2, 2), "b.py": (None, 3), "c.py": (1, 1), "d.py": (None, 1), "e.py": (None, 0)}
    letters = {(r.unit_key, r.attempt, r.error, r.lost) for r in attempts.dead_letters(placed, ended).collect()}
    unread = "no findings list in the response"
    assert letters == {(g("a.py"), 1, unread, False), (g("b.py"), 2, "timeout", True), (f("b.py"), 3, "no answer", True), (f("d.py"), 3, unread, True)}
    cases = spark.createDataFrame([(i, f"{x}.py", "missing" if x == "gone" else "ok") for i, x in enumerate(("a", "b", "c", "d", "e", "empty", "gone"))], "case_id long, file string, status string")
    expected = spark.createDataFrame([(i, "f", DZ, True) for i in range(7)], "case_id long, function string, category string, verifiable boolean")
    runs = spark.createDataFrame([], "file string, function string, stdout string, returncode int")
    counts, categories = flows.benchmark(cases, expected, units, answers, runs)
    assert {r.case_id: (r.bug_tp, r.bug_fp, r.bug_fn) for r in counts.collect()} == {0: (0, 0, 1), 2: (0, 1, 1), 5: (0, 0, 1), 6: (0, 0, 1)}
    assert {(r.flow, r.category): (r.tp, r.fp, r.fn) for r in categories.collect()} == {("llm", DZ): (0, 1, 3), ("hybrid", DZ): (0, 0, 3)}
    units.unpersist()


def test_prompts_keep_secrets(spark):
    u = code.extract_units(spark.createDataFrame([("dir/secret.py", "def f(a: int):\n    assert a\n    if a > 1:\n        return a / 2\n"), ("bad.py", "def (")], "path string, text string"))
    row = u.select(prompts.raw_prompt().alias("raw"), prompts.hints_prompt().alias("hints"), prompts.assertion_lines(F.col("source")).alias("a")).collect()
    assert len(row) == 1 and not any(x in row[0].raw for x in ("secret", "Guards", "branch_count", "operation_count", "Divisions"))
    assert all(x in row[0].raw for x in ("function f ", '"parameters":["a"]', '"type_hints":{"a":"int"}', '"line_count":4', '"parameter_count":1'))
    assert all(x in row[0].hints for x in ("- a > 1", "- line 4: a / 2", "- line 2: assert a", '"branch_count":1')) and row[0].a[0].relative_line == 2


def test_lint_rules(spark):
    near = lambda line: one(spark, lambda t: lint.near_line(t, F.lit("A  /b"), F.lit(line)), t="x\ny\na / B\nz\nw")
    assert [near(i) for i in (0, 1, 2, 3, 4, 5, 9)] == [False, False, True, True, True, False, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p" / "__pycache__").mkdir(parents=True)
    (tmp_path / "p" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "p" / "__pycache__" / "b.py").write_text("x")
    (tmp_path / "p" / "c.txt").write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in code.read_sources(spark, str(tmp_path / "p")).collect()] == ["a.py"]
    legacy = tmp_path / "legacy.json"
    legacy.write_text('{"a.py": {"expected_findings": [{"function": "f", "category": "x", "line": 2}]}}')
    assert [(r.file, r.function, r.line) for r in ground_truth.read_legacy(spark, str(legacy)).collect()] == [("a.py", "f", 2)]
    schema = "file string, note string, stdout string"
    rows = spark.createDataFrame([("a", 'say "x"', "out"), ("b", None, "")], schema).repartition(3)
    ground_truth.write_annotations(rows, str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("*.csv"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[0] == '"file","note","stdout"' and '"a","say ""x""","out"' in parts[0].read_text()
    back = spark.read.schema(schema).csv(str(tmp_path / "csv"), header=True, quote='"', escape='"').collect()
    assert {(r.file, r.note or "") for r in back} == {("a", 'say "x"'), ("b", "")}
    ground_truth.write_annotations(rows, str(tmp_path / "notes"), "json")
    assert spark.read.json(str(tmp_path / "notes")).count() == 2
    ground_truth.write_direct_results(rows, str(tmp_path / "json"))
    assert "stdout" not in "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    ground_truth.write_logs(rows, str(tmp_path / "logs"))
    assert spark.read.parquet(str(tmp_path / "logs")).count() == 2
    answers = spark.createDataFrame([("u", "{}")], ground_truth.RESPONSE)
    analyzers.record(analyzers.ReplayAnalyzer(answers), answers.select("unit_key"), str(tmp_path / "answers"))
    assert [(r.unit_key, r.response) for r in ground_truth.read_responses(spark, str(tmp_path / "answers")).collect()] == [("u", "{}")]
    spark.createDataFrame([("a", "f", "out", "", 0, 1.0)], ground_truth.VERIFIER).write.parquet(str(tmp_path / "runs"))
    assert ground_truth.read_runs(spark, str(tmp_path / "runs")).first().stdout == "out"
    assert analyzers.build_analyzer("google").model == "gemini-3.1-flash-lite" and isinstance(analyzers.build_analyzer("openai", responses=answers), analyzers.ReplayAnalyzer)
    with pytest.raises(ValueError):
        analyzers.build_analyzer("other", rows)


def test_ground_truth_layouts(spark, tmp_path):
    folder = tmp_path / "labelled" / "ground_truths" / "bugs"
    folder.mkdir(parents=True)
    item = {"id": "i", "file": "x.py", "function": "f", "expected_category": DZ, "verifiable": True}
    (folder / "division_by_zero.json").write_text(json.dumps({"items": [item, {"file": ""}]}))
    (folder / "other.json").write_text('{"no": 1}')
    (tmp_path / "old.json").write_text(json.dumps({"a.py": {"expected_findings": [{"function": "f", "category": DZ, "line": 2}]}}))
    tail = lambda rows: [r.source_path.split("/labelled/")[-1] for r in rows.collect()]
    assert tail(ground_truth.load_cases(spark, str(tmp_path / "labelled" / "ground_truths"))) == ["ok/bugs/division_by_zero/x.py"]
    assert tail(ground_truth.load_cases(spark, str(folder / "division_by_zero.json"))) == ["ok/bugs/division_by_zero/x.py"]
    old = ground_truth.load_cases(spark, str(tmp_path / "old.json")).collect()
    assert [(r.source_path, r.category) for r in old] == [(str(tmp_path / "a.py"), DZ)]


def test_report_sinks(spark, tmp_path):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    ground_truth.write_full_report(files, spark.createDataFrame([(2,)], "total_files int"), {"mode": "full"}, {"provided": False}, str(tmp_path / "full"))
    head = json.loads(next((tmp_path / "full" / "head").glob("part-*")).read_text())
    assert head == {"experiment": {"mode": "full"}, "ground_truth": {"provided": False}, "summary": {"total_files": 2}}
    assert spark.read.json(str(tmp_path / "full" / "files")).count() == 2
    reports = spark.createDataFrame([("m/1", (1,)), ("m 2", (2,))], "model string, report struct<tp:int>")
    ground_truth.write_benchmark_reports(reports, str(tmp_path / "bench"))
    found = {p.parent.name: json.loads(p.read_text()) for p in (tmp_path / "bench").glob("name=*/part-*")}
    assert found == {"name=m_1": {"tp": 1}, "name=m_2": {"tp": 2}}


def test_http_analyzer(spark):
    """A local server that fails once: only the backend that tries again gets its answer."""
    asked = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(503 if len(asked) % 2 else 200)
            self.end_headers()
            self.wfile.write(b'{"output_text": "yes"}')

        def log_message(self, *_):
            pass

    with http.server.HTTPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{server.server_port}/"
        waits = []
        assert analyzers.build_analyzer("openai", key="k", url=at).ask("p", waits.append) == '{"output_text": "yes"}' and waits == [1.0]
        assert asked[0][1]["input"] == "p" and asked[0][1]["temperature"] == 0 and asked[0][0]["Authorization"] == "Bearer k"
        with pytest.raises(RuntimeError):
            analyzers.build_analyzer("anthropic", key="k", url=at).ask("p")
        assert asked[2][1]["messages"][0]["content"] == "p" and asked[2][1]["system"] == prompts.SYSTEM and "text" not in asked[2][1]
        held = asked[0][1]["text"]["format"]
        assert asked[0][1]["instructions"] == prompts.SYSTEM and held["strict"] and held["schema"] == prompts.ANSWER_SCHEMA
        item = held["schema"]["properties"]["findings"]["items"]
        assert set(item["required"]) == {"finding_type", "category", "explanation", "verifiable", "metadata"} and set(item["properties"]["category"]["enum"]) == {*V.FORMAL, *V.SMELLS}
        units = spark.createDataFrame([("u", "p")], "unit_key string, prompt string")
        assert analyzers.build_analyzer("ollama", url=at).analyze(units).first().response == '{"output_text": "yes"}'
        last = asked[-1][1]
        assert last["response_format"] == {"type": "json_object"} and [m["role"] for m in last["messages"]] == ["system", "user"]
        server.shutdown()


def test_lint_shapes_and_functions(spark):
    shape = lambda *v: spark.range(1).select(lint.shape_issues(*[F.lit(x) for x in v])).first()[0]
    assert shape(DZ, True, True, "a / b", "") == [] and shape(DZ, False, True, "", "x") == ["verifiable", "expression"]
    assert shape("clean", False, False, "a", "x") == [] and shape("long_method", False, True, "a", "odd") == ["should_go_to_esbmc", "expected_type"] and shape("odd", True, True, "", "") == ["category"]
    assert "flask" in lint.DENIED and "matplotlib" not in lint.DENIED_STRICT
    text = "import flask\ndef s(a: int) -> int:\n    return a[0]\ndef t(a: int) -> int:\n    if a:\n        return 1\n    assert a\n    assert not a\n    return 1 % a\ndef v(a: int) -> int:\n    assert a\n    return a\n"
    sources = spark.createDataFrame([("d/x.py", text, "x.py")], "path string, text string, file string")
    units = code.extract_units(sources).withColumn("file", F.lit("x.py"))
    facts = code.file_facts(sources).withColumn("file", F.lit("x.py"))
    items = [("1", "x.py", "s", DZ, True, True, "a[0]", "", 3), ("2", "x.py", "t", "clean", False, False, "", "", 0), ("3", "x.py", "v", "clean", False, False, "", "", 0), ("4", "no.py", "s", DZ, True, True, "a[0]", "", 3), ("5", "x.py", "w", OOB, True, True, "a[ 0 ]", "", 3)]
    rows = spark.createDataFrame(items, "id string, file string, function string, category string, verifiable boolean, should_go_to_esbmc boolean, expression string, expected_type string, line int")
    got = {r.id: r.issues for r in lint.case_issues(rows, sources, facts, units).collect()}
    assert got == {"1": ["imports", "triggerable"], "2": ["imports"], "3": ["imports", "safe"], "4": ["file"], "5": ["function", "imports"]}
