"""Matching, counters, metrics, intervals and classes, restated on small inputs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from verdictflow.functions import metrics as M
from verdictflow.operators import bootstrap, classify, evaluation, matching, presentation, reports

EXPECTED = "case_id long, function string, category string, verifiable boolean"
FINDING = "case_id long, function string, category string, finding_type string, verifiable boolean, status string, property string"
DIRECT = "case_id long, function string, status string, property string"
DZ, OOB = "division_by_zero", "out_of_bounds"


@pytest.mark.parametrize(("counts", "want"), [((44, 11, 1, 0), (0.8, 0.9778, 0.88, None)), ((44, 4, 1, 0), (0.9167, 0.9778, 0.9462, None)), ((44, 6, 1, 4), (None, None, None, 0.5068)), ((44, 0, 1, 10), (None, None, None, 0.9428)), ((0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0)), ((24, 8, 21, 0), (0.75, 0.5333, 0.6234, None))])
def test_published_metrics(spark, counts, want):
    row = spark.createDataFrame([counts], "tp long, fp long, fn long, tn long").select(*[F.round(x, 4) for x in (M.precision("tp", "fp"), M.recall("tp", "fn"), M.f1("tp", "fp", "fn"), M.mcc("tp", "fp", "fn", "tn"))]).first()
    assert all(w is None or math.isclose(x, w) for x, w in zip(row, want))


def test_metrics_do_not_overflow(spark):
    big = 3_000_000_000
    assert spark.createDataFrame([(big, big, big, big)], "tp long, fp long, fn long, tn long").select(M.mcc("tp", "fp", "fn", "tn")).first()[0] == 0.0


def test_counting_equals_greedy_matching(spark):
    r = random.Random(1)
    draw = lambda n: [(r.randint(0, 20), r.choice("ab"), r.choice("fg")) for _ in range(n)]
    found, expected = draw(300), draw(200)
    left, verdicts = list(found), Counter()
    for e in expected:
        if e in left:
            left.remove(e)
            verdicts[(*e, "tp")] += 1
        else:
            verdicts[(*e, "fn")] += 1
    for f in left:
        verdicts[(*f, "fp")] += 1
    schema = "case_id long, category string, function string"
    rows = matching.match_verdicts(spark.createDataFrame(found, schema), spark.createDataFrame(expected, schema)).collect()
    assert Counter((x.case_id, x.category, x.function, x.verdict) for x in rows) == verdicts


def _counts(spark, expected, findings, direct=()):
    cases = sorted({x[0] for x in (*expected, *findings, *direct)})
    frames = (spark.createDataFrame([(c,) for c in cases], "case_id long"), spark.createDataFrame(list(expected), EXPECTED), spark.createDataFrame(list(findings), FINDING), spark.createDataFrame(list(direct), DIRECT))
    return {r.case_id: r.asDict() for r in evaluation.case_counts(*frames).collect()}


def test_case_counters(spark):
    expected = [(1, "f", DZ, True), (2, "f", "clean", False), (3, "f", "long_method", False), (4, "f", DZ, True), (5, "f", "clean", False), (6, "f", OOB, True)]
    findings = [
        (1, "f", DZ, "suspected_bug", True, "violation_found", DZ), (1, "f", DZ, "suspected_bug", True, "violation_found", DZ), (1, "f", OOB, "llm_false_positive", False, None, None), (1, "f", OOB, "suspected_bug", False, None, None),
        (2, "f", DZ, "suspected_bug", True, "no_violation_found", None), (2, "f", "long_method", "smell_heuristic", False, None, None), (3, "f", "long_method", "smell_heuristic", False, None, None),
        (4, "f", OOB, "suspected_bug", True, "violation_found", DZ), (4, "f", "style", "out_of_scope_finding", False, None, None),
    ]
    got = _counts(spark, expected, findings, [(4, "f", "violation_found", DZ), (6, "f", "violation_found", OOB), (6, "g", "violation_found", "unknown_esbmc_violation")])
    want = {
        1: {"bug_tp": 1, "bug_fp": 3, "bug_fn": 0, "func_tp": 1, "hallucinations": 1, "ghosts": 1, "confirmed": 2, "hybrid_tp": 1, "hybrid_fp": 1, "hybrid_func_tp": 1, "direct_fn": 1, "direct_func_fn": 1},
        2: {"bug_fp": 1, "smell_fp": 1, "func_fp": 1, "not_confirmed": 1, "hybrid_func_tn": 1, "direct_func_tn": 1},
        3: {"smell_tp": 1, "func_tp": 0, "func_tn": 0},
        4: {"bug_fp": 1, "bug_fn": 1, "func_fn": 1, "inconclusive": 1, "hybrid_fp": 1, "hybrid_fn": 1, "out_of_scope": 1, "direct_tp": 1, "native_bugs": 1, "missed_by_analyzer": 1},
        5: {"func_tn": 1, "bug_fp": 0},
        6: {"bug_fn": 1, "direct_tp": 1, "direct_fp": 1, "native_bugs": 2, "missed_by_analyzer": 2},
    }
    for case, own in want.items():
        assert {k: got[case][k] for k in own} == own, case


def test_rates(spark):
    row = dict.fromkeys(evaluation.COUNTERS, 0) | {"bug_tp": 44, "bug_fp": 11, "bug_fn": 1, "hybrid_fp": 4, "confirmed": 47, "not_confirmed": 6, "inconclusive": 1, "hallucinations": 1}
    out = evaluation.rates(spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} long" for c in row))).first()
    assert (out.confirmation_rate, out.noise_reduction, out.hallucination_rate) == (0.8704, 0.6364, 0.0182)


def anchor_counts(spark, missed: int = 4, n: int = 70):
    """Counters of 70 cases, 45 of them bugs and 10 clean, of which one bug is missed."""
    rows = []
    for i in range(n):
        c = dict.fromkeys(evaluation.COUNTERS, 0)
        bug, clean = i < 45, 45 <= i < 55
        c |= {"hybrid_tp": int(bug and i != missed), "hybrid_fn": int(bug and i == missed), "hybrid_func_tp": int(bug and i != missed), "hybrid_func_fn": int(bug and i == missed), "hybrid_func_tn": int(clean)}
        rows.append((i, *[c[k] for k in evaluation.COUNTERS]))
    return spark.createDataFrame(rows, "case_idx long, " + ", ".join(f"{c} long" for c in evaluation.COUNTERS))


def test_published_intervals(spark):
    """Two published runs: one missed case at position 5, and two at 5 and 15."""
    got = {r.metric: (round(r.low, 4), round(r.high, 4)) for r in bootstrap.intervals(anchor_counts(spark), bootstrap.seeded(70)).collect()}
    assert got["hybrid_bug_recall"] == (0.9286, 1.0) and got["hybrid_bug_mcc"] == (0.8117, 1.0)
    two = anchor_counts(spark).withColumns({c: F.when(F.col("case_idx") == 14, v).otherwise(F.col(c)) for c, v in (("hybrid_tp", 0), ("hybrid_fn", 1), ("hybrid_func_tp", 0), ("hybrid_func_fn", 1))})
    got = {r.metric: (round(r.low, 4), round(r.high, 4)) for r in bootstrap.intervals(two, bootstrap.seeded(70)).collect()}
    assert got["hybrid_bug_recall"] == (0.8889, 1.0) and got["hybrid_bug_mcc"] == (0.7347, 1.0)


def test_rows_that_match(spark):
    """As a plain greedy loop pairs them; one key has most of the rows, and is ranked by many tasks."""
    r = random.Random(7)
    keys = [("hot", "f")] * 400 + [(c, f) for c in "ab" for f in "fg"] * 5 + [(None, "f")] * 2
    found, expected = [(*k, p) for p, k in enumerate(r.sample(keys, 300))], [(*k, p) for p, k in enumerate(r.sample(keys, 250))]
    left, want = list(found), []
    for e in expected:
        hit = next((g for g in left if g[:2] == e[:2] and None not in e), None)
        want.append((hit and hit[2], e[2]))
        left = [g for g in left if g is not hit]
    want += [(g[2], None) for g in left]
    sides = spark.createDataFrame(found, "category string, function string, pos int"), spark.createDataFrame(expected, "category string, function string, ord int")
    got = matching.match_rows(*sides, ["category", "function"]).collect()
    assert Counter((x.found and x.found.pos, x.expected and x.expected.ord) for x in got) == Counter(want)
    assert all(x.verdict == ("fp" if x.expected is None else "fn" if x.found is None else "tp") for x in got)
    parts = matching.ranked(sides[0].where("category = 'hot'"), ["category", "function"], "pos")
    assert sorted(x["rank"] for x in parts.collect()) == list(range(1, parts.count() + 1))
    assert matching.match_rows(sides[0].limit(0), sides[1].limit(0), ["category", "function"]).count() == 0


@pytest.mark.parametrize(("n", "turns", "per"), [(1, 3, 2), (2, 5, 5), (70, 40, 7), (1024, 12, 5), (1500, 9, 4)])
def test_seeded_draws_are_those_of_choice(n, turns, per, monkeypatch):
    """From the states that the driver keeps, groups of turns go on alike in any order."""
    monkeypatch.setattr(bootstrap, "GROUP_TURNS", per)
    monkeypatch.setattr(bootstrap, "CHUNK", 1000)
    r, draws = random.Random(42), bootstrap.seeded(n, turns)
    want = [[r.choice(range(n)) for _ in range(n)] for _ in range(turns)]
    got = {g: [x.tolist() for x in draws.of(g)] for g in reversed(range(draws.groups))}
    assert [x for g in range(draws.groups) for x in got[g]] == want


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_intervals_equal_a_plain_loop(spark, monkeypatch, block):
    """Also of a metric and a counter that the caller adds."""
    monkeypatch.setattr(bootstrap, "BLOCK", block)
    r, n, turns = random.Random(3), 30, 60
    rows = [tuple(r.randint(0, 3) for _ in evaluation.COUNTERS) + (r.randint(0, 9),) for _ in range(n)]
    counters = [*evaluation.COUNTERS, "lines"]
    counts = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "case_idx long, " + ", ".join(f"{c} long" for c in counters)).repartition(3)
    extra = {"found_per_line": M.ratio("bug_tp", "lines")}
    got = {x.metric: (x.low, x.high) for x in bootstrap.intervals(counts, bootstrap.seeded(n, turns, 5), 0.9, extra, counters).collect()}
    draw, values = random.Random(5), {"found_per_line": [], "smell_recall": []}
    for _ in range(turns):
        total = dict(zip(counters, map(sum, zip(*[draw.choice(rows) for _ in range(n)]))))
        values["found_per_line"].append(total["bug_tp"] / total["lines"])
        values["smell_recall"].append(total["smell_tp"] / (total["smell_tp"] + total["smell_fn"]))
    for k, v in values.items():
        assert got[k] == (sorted(v)[int((1 - 0.9) / 2 * turns)], sorted(v)[min(int((1 - (1 - 0.9) / 2) * turns), turns - 1)])
    assert len(got) == 16
    with pytest.raises(ValueError):
        evaluation.metric_columns({"smell_f1": F.lit(1)})


def test_final_classes(spark):
    rows = [
        ("out_of_scope_finding", None, None, None, False, "out_of_scope_finding"), ("llm_false_positive", None, None, None, False, "llm_false_positive"), ("smell_heuristic", None, None, None, False, "heuristic_smell_only"),
        ("suspected_bug", "violation_found", True, None, True, "llm_only_suspected"), ("suspected_bug", None, None, "violation_found", False, "esbmc_native_bug"), ("suspected_bug", "skipped", None, None, False, "skipped_not_verifiable"),
        ("suspected_bug", "violation_found", True, None, False, "llm_confirmed_by_esbmc"), ("suspected_bug", "violation_found", False, None, False, "esbmc_inconclusive"), ("suspected_bug", "no_violation_found", None, None, False, "not_confirmed_within_bound"),
        ("suspected_bug", "tool_error", None, None, False, "esbmc_inconclusive"), ("direct_observation", None, None, None, False, "skipped_not_verifiable"),
    ]
    df = spark.createDataFrame(rows, "t string, s string, m boolean, d string, o boolean, want string")
    assert all(r.got == r.want for r in df.withColumn("got", classify.final_class(F.col("t"), F.col("s"), F.col("m"), F.col("d"), F.col("o"))).collect())


def test_file_class_and_notes(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file string")
    rows = spark.createDataFrame([("a", "heuristic_smell_only"), ("a", "esbmc_inconclusive")], "file string, final_class string")
    assert {r.file: r.file_class for r in classify.file_class(files, rows).collect()} == {"a": "esbmc_inconclusive", "b": "clean"}
    ranked = ["llm_false_positive", "not_confirmed_within_bound", "esbmc_inconclusive", "out_of_scope_finding", "heuristic_smell_only", "skipped_not_verifiable", "llm_only_suspected"]
    one = spark.createDataFrame([("a", c) for c in ranked[1:]], "file string, final_class string")
    assert {r.file: r.file_class for r in classify.file_class(files, one).collect()}["a"] == "not_confirmed_within_bound"
    assert {r.file_class for r in classify.file_class(files, spark.createDataFrame([("b", "llm_only_suspected")], "file string, final_class string")).collect()} == {"clean"}
    schema = "row_key string, verdict string, note string"
    notes = spark.createDataFrame([("k", "confirmed", "x"), ("l", "confirmed", "y")], schema)
    out = reports.upsert_notes(notes, spark.createDataFrame([("k", "", ""), ("m", "", "new")], schema)).collect()
    assert {r.row_key for r in out} == {"l", "m"}


def test_category_counts_of_smells_hybrid_and_clean_cases(spark):
    expected = [(1, "f", DZ, True), (2, "f", "clean", False), (3, "f", "long_method", False)]
    findings = [
        (1, "f", DZ, "suspected_bug", True, "violation_found", DZ), (1, "f", OOB, "suspected_bug", True, "violation_found", DZ), (2, "f", "long_method", "smell_heuristic", False, None, None),
        (2, "f", DZ, "llm_false_positive", False, None, None), (3, "f", "long_method", "smell_heuristic", False, None, None), (3, "f", "many_parameters", "smell_heuristic", False, None, None),
    ]
    got = {(r.flow, r.category): (r.tp, r.fp, r.fn) for r in evaluation.category_counts(spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(findings, FINDING)).collect()}
    assert got == {("llm", DZ): (1, 1, 0), ("llm", OOB): (0, 1, 0), ("llm", "long_method"): (1, 1, 0), ("llm", "many_parameters"): (0, 1, 0), ("hybrid", DZ): (1, 0, 0), ("hybrid", OOB): (0, 1, 0)}


def test_counters_take_two_shuffles_and_no_join(spark):
    one = lambda row, schema: spark.createDataFrame([row], schema)
    out = evaluation.case_counts(one((1,), "case_id long"), one((1, "f", DZ, True), EXPECTED), one((1, "f", DZ, "suspected_bug", True, None, None), FINDING), one((1, "f", "violation_found", DZ), DIRECT))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_numbering_of_ranges(spark):
    keys = [7 * i % 1009 for i in range(1009)]
    got = {r.k: r.case_idx for r in bootstrap.numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 16).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert bootstrap.numbered(spark.createDataFrame([], "k long"), "k").count() == 0


def test_report_parts(spark):
    text = lambda **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v))
    told = {}
    for final in (*classify.PRIORITY, "llm_only_suspected", "clean"):
        told[final] = text(f=final, c=DZ, e="a / b", d="detail").select(classify.interpretation(F.col("f"), F.col("c"), F.col("e"), F.lit("low"), F.col("d"))).first()[0]
    assert len(set(told.values())) == len(told) and all(told.values()) and told["clean"] == "detail"
    v = spark.createDataFrame([("suspected_bug", "true", None), ("suspected_bug", "false", "true"), ("llm_false_positive", "true", None), ("odd", None, None)], "t string, g string, u string").select(classify.validation(F.col("t"), F.col("g"), F.col("u")).alias("v")).collect()
    assert [(r.v.valid, r.v.has_guard, r.v.ast_unrecognized) for r in v] == [(True, True, False), (True, False, True), (False, False, None), (False, False, None)]
    direct = spark.createDataFrame([("a", 1, None), ("a", 3, "late"), ("a", 2, "first")], "file string, ord int, direct string")
    assert [(r.file, r.direct) for r in classify.first_direct(direct).collect()] == [("a", "first")]
    assert classify.ground_truth_block(None)["provided"] is False
    assert classify.ground_truth_block(spark.createDataFrame([("a",), ("a",), ("b",)], "file string"))["total_expected_findings"] == 3
    assert classify.experiment_block("full", None, "x", 5, 30, "t")["model"] == "unknown"
    formats = {'[{"a": 1}]': "flat", '{"files": [], "summary": {}, "experiment": {}}': "full", '{"metrics": {}, "backend": "x"}': "benchmark", '{"metrics": {}}': "unknown"}
    assert all(text(t=t).select(reports.report_format(F.col("t"))).first()[0] == want for t, want in formats.items())
    rows = spark.createDataFrame([("k", "m", "llm_confirmed_by_esbmc"), ("l", "m", "llm_false_positive"), ("o", "n", "x")], "row_key string, model string, final_class string")
    notes = spark.createDataFrame([("k", "false_positive", None), ("l", None, "")], "row_key string, verdict string, note string")
    s = reports.stats(rows, reports.search(rows, notes, verdict=reports.EMPTY_FILTER), notes).first()
    assert (s.models, s["rows"], s.visible, s.annotated, s.confirmed, s.false_positives) == (2, 3, 2, 1, 1, 1)
    assert [r.row_key for r in reports.annotated(rows, notes).collect()] == ["k"]
    assert [r.row_key for r in reports.search(rows, notes, text=" LLM_false ").collect()] == ["l"]
    assert [r.model for r in reports.models(rows).collect()] == ["m", "n"]


def test_tables_for_people(spark):
    rows = spark.createDataFrame([("a_b", 0.5, None), ("c&d", 1.0, 3)], "model string, f1 double, tp int")
    assert presentation.ascii_table(rows).splitlines() == ["model  f1      tp", "-----  ------  ---", "a_b    0.5000  N/A", "c&d    1.0000  3"]
    tex = presentation.latex_table(rows, "50% done")
    assert r"a\_b & 0.5000 & N/A \\" in tex and r"c\&d" in tex and r"\caption{50\% done}" in tex
    reports = spark.createDataFrame([("x.json", '{"model": "<m>", "metrics": {"smells": {"f1": 0.5, "tp": 1}}, "note": "</script>"}')], "file string, report string")
    page = presentation.dashboard(reports)
    assert "<td>&lt;m&gt;</td><td>smells</td>" in page and page.count("</script>") == 1
    runs = spark.createDataFrame([("m", 0, 1.5, "r.json"), ("n", 1, 0.5, "s.json")], "model string, returncode int, elapsed_seconds double, report string")
    told = presentation.manifest(runs, "now")
    assert told["failed"] and [x["status"] for x in told["runs"]] == ["ok", "failed"]


def test_reports_in_one_pass(spark):
    """The same counts as case by case and category by category; one case holds a third of all findings."""
    r = random.Random(5)
    cases = spark.createDataFrame([(i, "abc"[i % 3] if i < 58 else None) for i in range(60)], "case_id long, model string")
    pick = lambda: 7 if r.random() < 0.34 else r.randrange(60)
    expected = [(c, r.choice("fg"), r.choice(["x", "y"]), True) if c % 4 else (c, "f", "clean", False) for c in [pick() for _ in range(150)]] + [(c, "f", "long", False) for c in range(0, 60, 5)]
    kinds = [("suspected_bug", True), ("smell_heuristic", False), ("suspected_bug", False), ("llm_false_positive", False), ("out_of_scope_finding", False)]
    found = [(pick(), r.choice("fg"), r.choice(["x", "y", "z", "long"]), *r.choice(kinds), r.choice(["violation_found", "no_violation_found", "skipped", None]), r.choice("xy")) for _ in range(600)]
    direct = spark.createDataFrame([(pick(), r.choice("fg"), r.choice(["violation_found", "no_violation_found"]), r.choice("xy")) for _ in range(120)], "case_id long, function string, status string, property string")
    expected = spark.createDataFrame(expected, "case_id long, function string, category string, verifiable boolean")
    found = spark.createDataFrame(found, "case_id long, function string, category string, finding_type string, verifiable boolean, status string, property string")
    got = {row["model"]: row for row in evaluation.report_counts(cases, expected, found, direct).collect()}
    want = evaluation.totals(evaluation.case_counts(cases.select("case_id"), expected, found, direct).join(cases, "case_id"), ["model"]).collect()
    assert {row["model"]: [row[c] for c in evaluation.COUNTERS] for row in want} == {m: [row[c] for c in evaluation.COUNTERS] for m, row in got.items()}
    per = evaluation.category_counts(expected.join(cases, "case_id"), found.join(cases, "case_id"), ["model"]).collect()
    assert sorted(((p.model or "-", p.flow, p.category, p.tp, p.fp, p.fn) for p in per)) == sorted((m or "-", flow, *c) for m, row in got.items() for flow in ("llm", "hybrid") for c in row[flow])
    assert evaluation.report_counts(cases.limit(0), expected.limit(0), found.limit(0), direct.limit(0)).count() == 0
