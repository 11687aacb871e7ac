"""From recorded responses to normalized findings: explode, defaults, checks against the unit's source, decision table.

units: unit_key, qualname, source, operations, guards, exec_exprs, assert_tests (of sources.code). Findings are
checked by joining them to their unit, so no source is shipped to the driver; only the reported expressions go
through Python's parser, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import findings as A
from ..sources.code import expression_facts

METADATA = ("expression", "line", "relative_line", "expected_exception", "original_category", "has_guard", "ast_unrecognized")


def explode_findings(responses: DataFrame, text: str = "response", key: str = "unit_key") -> DataFrame:
    """One row for each finding, with key and pos (from 1); a response without a findings list gives one row with `error`."""
    found = F.coalesce(A.parse_response(F.col(text)), F.array(F.lit(None)))
    out = responses.select("*", F.posexplode(found).alias("_pos", "_f"))
    own = [c for c in responses.columns if c != text]
    error = F.when(F.col("_f").isNull(), "no findings list in the response")
    return out.select(*own, F.when(F.col("_f").isNotNull(), F.col("_pos") + 1).alias("pos"), error.alias("error"), "_f.*")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Typed findings: blank fields take their defaults, lines become integers, evidence a list."""
    m = F.col("metadata")
    return rows.where("error is null").withColumns({
        "id": A.or_default(F.col("id"), "unknown"), "stage": A.or_default(F.col("stage"), "llm_analysis"), "finding_type": A.or_default(F.col("finding_type"), "smell_heuristic"),
        "category": A.or_default(F.col("category"), "unknown"), "title": F.coalesce("title", F.lit("")), "explanation": F.coalesce("explanation", F.lit("")), "evidence": F.coalesce("evidence", F.array().cast("array<string>")),
        "verifiable": F.coalesce("verifiable", F.lit(False)), "confidence": A.or_default(F.col("confidence"), "low"),
        "expression": F.coalesce(m["expression"], F.lit("")), "line": A.safe_int(m["line"]), "relative_line": A.safe_int(m["relative_line"]), "expected_exception": F.coalesce(F.col("expected_exception"), F.lit("")),
    }).drop("metadata", "error")


def find_operation(operations: Column, kind: Column, expression: Column) -> Column:
    """The first operation of the kind whose expression is the one given; a blank one takes any."""
    return F.get(F.filter(operations, lambda o: (o["kind"] == kind) & ((expression == "") | (o["expression"] == expression))), F.lit(0))


def assertion_in_source(expression: Column, assertion: Column, source: Column, tests: Column) -> Column:
    """A blank expression wants any assert; else it is a part of the source's text, or equals an assert's test as a tree."""
    said = A.stripped(expression)
    return F.when(said == "", F.size(tests) > 0).otherwise(F.contains(source, said) | F.coalesce(F.array_contains(tests, assertion), F.lit(False)))


def normalize_findings(units: DataFrame, findings: DataFrame, key: str = "unit_key", keep: dict[str, str] | None = None) -> DataFrame:
    """findings (with defaults, key and pos) with id, finding_type, verifiable, the rule applied and metadata settled.

    keep: columns of units to add, by their new names. Findings of units that are not in `units` are dropped. Repeated rows are findings of their own; ties of pos go by id.
    """
    place = units.select(key, "qualname", "source", "operations", "guards", "exec_exprs", "assert_tests", *[F.col(c).alias(name) for name, c in (keep or {}).items()])
    rows = findings.join(place, key).withColumn("_x", expression_facts(F.col("expression")))
    expression, category = F.col("expression"), F.col("category")
    found = find_operation(F.col("operations"), A.operation_kind(category), expression)
    rows = rows.withColumn("_op", found).withColumns({
        "_asserted": assertion_in_source(expression, F.col("_x.assertion"), F.col("source"), F.col("assert_tests")),
        "_executable": (expression != "") & F.coalesce(F.array_contains("exec_exprs", F.col("_x.normal")), F.lit(False)),
        "_constant": (category == "division_by_zero") & F.col("_x.constant_divisor"),
    })
    rows = rows.withColumn("_n", A.normal_form(F.col("finding_type"), category, F.col("verifiable"), F.col("_asserted"), F.col("_op").isNotNull(), F.col("_executable"), F.col("_constant")))
    rule = F.col("_n.rule")
    guarded = (expression != "") & A.guard_covers(category, expression, F.col("guards"))
    preferred = A.stripped(F.col("id"))
    unit = Window.partitionBy(key).orderBy("pos", "id")
    rows = rows.withColumn("_at", F.row_number().over(unit)).withColumn("_id", F.when(preferred == "", F.concat("qualname", F.lit(":llm:"), F.col("_at").cast("string"))).otherwise(preferred))
    again = F.row_number().over(Window.partitionBy(key, "_id").orderBy("_at"))
    settled = {
        "id": A.unique_id(F.col("_id"), again, F.col("_at")),
        "line": F.when(rule.isin("N5", "N6"), F.col("_op.line")).otherwise(F.col("line")),
        "relative_line": F.when(rule.isin("N5", "N6"), F.col("_op.relative_line")).otherwise(F.col("relative_line")),
        "original_category": F.when(rule == "N1", category),
        "has_guard": F.when(rule == "N6", guarded.cast("string")).when(~rule.isin("N4", "N10"), "false"),
        "ast_unrecognized": F.when(rule == "N8", "true"),
        "rule": rule, "finding_type": F.col("_n.finding_type"), "verifiable": F.col("_n.verifiable"),
    }
    return rows.withColumns(settled).drop("qualname", "source", "operations", "guards", "exec_exprs", "assert_tests", "_x", "_op", "_asserted", "_executable", "_constant", "_n", "_at", "_id")


def analyzed(units: DataFrame, responses: DataFrame, key: str = "unit_key") -> DataFrame:
    """Normalized findings of recorded responses (key, response), with path and function of their unit."""
    known = with_defaults(explode_findings(responses.select(key, "response"), key=key))
    # One join and no other use of `units`: a second one would parse the sources again.
    return normalize_findings(units, known, key, {"path": "path", "function": "name", "unit_name": "qualname"})
