"""Counters of each case, totals, and the metrics that follow from them.

findings: case_id, function, category, finding_type, verifiable, status, property (category of what
the verifier found). expected: case_id, function, category, verifiable. direct: case_id, function,
status, property, from the verifier alone. cases: case_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.verifier import NO_VIOLATION, SKIPPED, VIOLATION, property_category
from .matching import KEYS

COUNTERS = ["bug_tp", "bug_fp", "bug_fn", "smell_tp", "smell_fp", "smell_fn", "func_tp", "func_fp", "func_fn", "func_tn", "hallucinations", "ghosts", "out_of_scope", "confirmed", "not_confirmed", "inconclusive", "skipped", "hybrid_tp", "hybrid_fp", "hybrid_fn", "hybrid_func_tp", "hybrid_func_fp", "hybrid_func_fn", "hybrid_func_tn", "direct_tp", "direct_fp", "direct_fn", "direct_func_tp", "direct_func_fp", "direct_func_fn", "direct_func_tn", "native_bugs", "missed_by_analyzer"]


def confirmation(status, prop, category):
    """What the verifier says of a verifiable finding."""
    return F.when((status == VIOLATION) & (prop == category), "confirmed").when(status == VIOLATION, "inconclusive").when(status == NO_VIOLATION, "not_confirmed").when(status == SKIPPED, "skipped").otherwise("inconclusive")


def is_smell():
    return ~F.col("verifiable") & (F.col("finding_type") == "smell_heuristic")


def is_ghost():
    return ~F.col("verifiable") & (F.col("finding_type") == "suspected_bug")


#: Columns of key_counts(): how many rows of each kind a match key has.
_KINDS = ("g_bug", "g_smell", "hallucinations", "ghosts", "out_of_scope", "confirmed", "not_confirmed", "inconclusive", "skipped", "e_bug", "e_smell", "e_clean", "e_any", "native", "is_case")


_SUMS = [*_KINDS, *[f"{p}_{c}" for p in "bshd" for c in ("tp", "fp", "fn")], "stray", "missed"]


def _kinds(rows: DataFrame, *more: str, **kinds) -> DataFrame:
    return rows.select(*KEYS, *more, *[(kinds[k].cast("long") if k in kinds else F.lit(0).cast("long")).alias(k) for k in _KINDS])


def key_counts(cases: DataFrame, expected: DataFrame, findings: DataFrame, direct: DataFrame, by: str | None = None) -> DataFrame:
    """KEYS and _KINDS: one aggregate over all inputs. A case is a row of its own, with null function and category, and the only one with its `by`."""
    own = [by] if by else []
    verdict = F.when(F.col("verifiable"), confirmation(F.col("status"), F.col("property"), F.col("category")))
    told = _kinds(
        findings, g_bug=F.col("verifiable"), g_smell=is_smell(), hallucinations=F.col("finding_type") == "llm_false_positive", ghosts=is_ghost(), out_of_scope=F.col("finding_type") == "out_of_scope_finding",
        **{k: F.coalesce(verdict == k, F.lit(False)) for k in ("confirmed", "not_confirmed", "inconclusive", "skipped")},
    )
    bug, clean = F.col("verifiable"), F.col("category") == "clean"
    wanted = _kinds(expected, e_bug=bug, e_smell=~bug & ~clean, e_clean=clean, e_any=F.lit(True))
    native = _kinds(direct.where(F.col("status") == VIOLATION).withColumn("category", F.col("property")), native=F.lit(True))
    known = _kinds(cases.select("case_id", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("function"), *own), *own, is_case=F.lit(True))
    rows = told.unionByName(wanted).unionByName(native).unionByName(known, allowMissingColumns=True)
    return rows.groupBy(*KEYS).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in _KINDS], *[F.max(c).alias(c) for c in own])


def _matched(g: str, e: str, prefix: str) -> dict:
    """Greedy one-to-one matching of g found and e expected rows of a key, as counts."""
    found, wanted = F.col(g), F.col(e)
    return {f"{prefix}_tp": F.least(found, wanted), f"{prefix}_fp": F.greatest(found - wanted, F.lit(0)), f"{prefix}_fn": F.greatest(wanted - found, F.lit(0))}


def _flow_counts(keys: DataFrame) -> DataFrame:
    """key_counts() with the matches of each flow; an inconclusive finding that nobody expected counts as `stray`."""
    return keys.withColumns(_matched("g_bug", "e_bug", "b") | _matched("g_smell", "e_smell", "s") | _matched("confirmed", "e_bug", "h") | _matched("native", "e_bug", "d") | {"stray": F.when(F.col("e_bug") == 0, F.col("inconclusive")).otherwise(0), "missed": F.greatest(F.col("native") - F.col("g_bug"), F.lit(0))})


def _counted(out: DataFrame) -> DataFrame:
    """Rows with the _SUMS of a case, with its COUNTERS beside them."""
    clean, extra = (F.col("e_any") > 0) & (F.col("e_any") == F.col("e_clean")), F.col("hallucinations") + F.col("ghosts")
    has_bugs = F.col("e_bug") > 0
    out = out.withColumns({
        "clean": clean, "bug_tp": F.when(clean, 0).otherwise(F.col("b_tp")), "bug_fn": F.when(clean, 0).otherwise(F.col("b_fn")), "bug_fp": F.when(clean, F.col("g_bug") + extra).otherwise(F.col("b_fp") + extra),
        "smell_tp": F.when(clean, 0).otherwise(F.col("s_tp")), "smell_fn": F.when(clean, 0).otherwise(F.col("s_fn")), "smell_fp": F.when(clean, F.col("g_smell")).otherwise(F.col("s_fp")),
        "hybrid_tp": F.col("h_tp"), "hybrid_fp": F.col("h_fp") + F.col("stray"), "hybrid_fn": F.col("h_fn"), "direct_tp": F.col("d_tp"), "direct_fp": F.col("d_fp"), "direct_fn": F.col("d_fn"),
        "native_bugs": F.col("native"), "missed_by_analyzer": F.col("missed"),
    })
    for flow, func in (("bug", "func"), ("hybrid", "hybrid_func"), ("direct", "direct_func")):
        tp, fp = F.col(f"{flow}_tp") > 0, F.col(f"{flow}_fp") > 0
        out = out.withColumns({f"{func}_tp": (has_bugs & tp).cast("long"), f"{func}_fn": (has_bugs & ~tp).cast("long"), f"{func}_fp": (~has_bugs & clean & fp).cast("long"), f"{func}_tn": (~has_bugs & clean & ~fp).cast("long")})
    return out


def case_counts(cases: DataFrame, expected: DataFrame, findings: DataFrame, direct: DataFrame) -> DataFrame:
    """case_id and COUNTERS, for every case: one aggregate by match key, then one by case; no joins."""
    each = _flow_counts(key_counts(cases, expected, findings, direct))
    out = _counted(each.groupBy("case_id").agg(*[F.sum(c).alias(c) for c in _SUMS]).where("is_case > 0"))
    return out.select("case_id", *[F.col(c).cast("long").alias(c) for c in COUNTERS])


def report_counts(cases: DataFrame, expected: DataFrame, findings: DataFrame, direct: DataFrame, by: str = "model") -> DataFrame:
    """by, COUNTERS, and what category_counts() tells as arrays llm and hybrid of (category, tp, fp, fn), in one pass.

    cases has the column `by`. Every input is read once: a key's rows are added up, then a case's categories, which see
    the sums of their case by a window, then categories by `by`. A null category counts as a blank one.
    """
    each = _flow_counts(key_counts(cases, expected, findings, direct, by)).withColumn("category", F.coalesce("category", F.lit("")))
    rows = each.groupBy("case_id", "category").agg(*[F.sum(c).alias(c) for c in _SUMS], F.max(by).alias(by))
    case = Window.partitionBy("case_id")
    wide = rows.select("category", *[F.col(c).alias(f"own_{c}") for c in _SUMS], *[F.sum(c).over(case).alias(c) for c in _SUMS], F.max(by).over(case).alias(by), (F.row_number().over(case.orderBy("category")) == 1).alias("first"))
    wide = _counted(wide.where("is_case > 0"))
    own = lambda c: F.col(f"own_{c}")
    n = lambda c: F.when(F.col("clean"), 0).otherwise(own(f"b_{c}") + own(f"s_{c}"))
    told = F.when(F.col("clean"), own("g_bug") + own("g_smell")).otherwise(own("b_fp") + own("s_fp")) + own("hallucinations") + own("ghosts")
    flows = {"llm": (n("tp"), told, n("fn")), "hybrid": (own("h_tp"), own("h_fp") + own("stray"), own("h_fn"))}
    parts = {f"{flow}_{c}_": v for flow, vs in flows.items() for c, v in zip(("tp", "fp", "fn"), vs)}
    small = wide.groupBy(by, "category").agg(*[F.sum(F.when(F.col("first"), F.col(c)).otherwise(0)).alias(c) for c in COUNTERS], *[F.sum(v).alias(k) for k, v in parts.items()])

    def listed(flow: str) -> Column:
        tp, fp, fn = (F.col(f"{flow}_{c}_") for c in ("tp", "fp", "fn"))
        cell = F.struct("category", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
        return F.sort_array(F.collect_list(F.when(tp + fp + fn > 0, cell))).alias(flow)

    return small.groupBy(by).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS], listed("llm"), listed("hybrid"))


def missing_file_counts(cases: DataFrame, expected: DataFrame) -> DataFrame:
    """Counters of cases whose file is missing: all that was expected is a false negative."""
    per = expected.groupBy("case_id").agg(F.count_if("verifiable").alias("b"), F.count_if(~F.col("verifiable") & (F.col("category") != "clean")).alias("s"))
    rows = cases.join(per, "case_id", "left").na.fill(0)
    own = {"bug_fn": F.col("b"), "hybrid_fn": F.col("b"), "direct_fn": F.col("b"), "smell_fn": F.col("s")} | {c: (F.col("b") > 0).cast("long") for c in ("func_fn", "hybrid_func_fn", "direct_func_fn")}
    return rows.select("case_id", *[own.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def category_counts(expected: DataFrame, findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, flow, category, tp, fp, fn (by: columns of both inputs that follow from the case): the analyzer's bugs and smells (llm), and what the verifier confirmed (hybrid).

    Hallucinations and ghosts are false positives of their category; in a clean case all findings are. Categories
    without any verdict have no row.
    """
    none = expected.select("case_id", "function", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("property")).limit(0)
    each = _flow_counts(key_counts(expected.select("case_id").limit(0), expected, findings, none))
    by = by or []
    cases = expected.select("case_id", "category", *by).unionByName(findings.select("case_id", F.lit(None).cast("string").alias("category"), *by))
    cases = cases.groupBy("case_id").agg(F.coalesce(F.bool_and(F.col("category") == "clean"), F.lit(False)).alias("clean"), *[F.max(c).alias(c) for c in by])
    each = each.join(cases, "case_id")
    n = lambda c: F.when(F.col("clean"), 0).otherwise(F.col(f"b_{c}") + F.col(f"s_{c}"))
    told = F.when(F.col("clean"), F.col("g_bug") + F.col("g_smell")).otherwise(F.col("b_fp") + F.col("s_fp")) + F.col("hallucinations") + F.col("ghosts")
    row = lambda flow, tp, fp, fn: F.struct(F.lit(flow).alias("flow"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    flows = F.array(row("llm", n("tp"), told, n("fn")), row("hybrid", F.col("h_tp"), F.col("h_fp") + F.col("stray"), F.col("h_fn")))
    long = each.select(*by, "category", F.explode(flows).alias("x")).groupBy(*by, "x.flow", "category").agg(*[F.sum(f"x.{c}").cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return long.where("tp + fp + fn > 0")


def flow_a_findings(functions: DataFrame) -> DataFrame:
    """case_id, function, status, property of the functions of files with a violation: rows (case_id, function, status, property_kind, property_text)."""
    return functions.where(F.col("status") == VIOLATION).select("case_id", "function", "status", property_category(F.concat_ws(" ", F.coalesce("property_kind", F.lit("")), F.coalesce("property_text", F.lit("")))).alias("property"))


def totals(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return counts.groupBy(*(by or [])).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


FLOWS = {"llm": ("bug", "func"), "hybrid": ("hybrid", "hybrid_func"), "esbmc": ("direct", "direct_func")}


def metric_columns(extra: dict[str, Column] | None = None) -> dict[str, Column]:
    """The fifteen metrics that get confidence intervals, as columns over counters, and the caller's own under names of their own."""
    out = {}
    for flow, (c, f) in FLOWS.items():
        tp, fp, fn = f"{c}_tp", f"{c}_fp", f"{c}_fn"
        out |= {f"{flow}_bug_precision": M.precision(tp, fp), f"{flow}_bug_recall": M.recall(tp, fn), f"{flow}_bug_f1": M.f1(tp, fp, fn), f"{flow}_bug_mcc": M.mcc(f"{f}_tp", f"{f}_fp", f"{f}_fn", f"{f}_tn")}
    tp, fp, fn = "smell_tp", "smell_fp", "smell_fn"
    out |= {"smell_precision": M.precision(tp, fp), "smell_recall": M.recall(tp, fn), "smell_f1": M.f1(tp, fp, fn)}
    if taken := sorted(out.keys() & (extra or {}).keys()):
        raise ValueError(f"metrics of these names exist: {taken}")
    return out | (extra or {})


def rates(total: DataFrame, keep: list[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Metrics (the caller's own too), accuracies and rates of summed counters, rounded to four digits."""
    own = metric_columns(extra) | {f"{flow}_accuracy": M.accuracy(f"{f}_tp", f"{f}_fp", f"{f}_fn", f"{f}_tn") for flow, (_, f) in FLOWS.items()}
    own |= {"hallucination_rate": M.hallucination_rate("hallucinations", "bug_tp", "bug_fp", "ghosts"), "confirmation_rate": M.confirmation_rate("confirmed", "not_confirmed", "inconclusive"), "noise_reduction": M.noise_reduction("bug_fp", "hybrid_fp")}
    return total.select(*(keep or []), *[F.round(v, 4).alias(k) for k, v in own.items()])
