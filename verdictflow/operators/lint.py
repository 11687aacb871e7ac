"""Rules for labelled data sets: each gives issues as an array, so a row can break several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.verifier import FORMAL, SMELLS

# Packages that labelled code must not import, and two more that the stricter list has.
DENIED = ("numpy", "pandas", "requests", "flask", "django", "scipy", "sklearn", "torch", "tensorflow")
DENIED_STRICT = (*DENIED, "pytest", "hypothesis")
#: What a function must hold to have a fault of the category.
RISK = {"division_by_zero": "division", "out_of_bounds": "subscript", "assertion_violation": "assert"}


def issues(*rules: tuple[str, Column]) -> Column:
    """Names of the rules whose condition (a fault) holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def shape_issues(category: Column, verifiable: Column, to_verifier: Column, expression: Column, expected_type: Column) -> Column:
    """Constraints between the fields of a ground-truth item, by category; a null flag breaks its rule."""
    named = F.coalesce(category, F.lit(""))
    bug, smell, clean = named.isin(*FORMAL), named.isin(*SMELLS), named == "clean"
    other = smell | clean
    wrong = lambda flag: (bug & ~F.coalesce(flag, F.lit(False))) | (other & F.coalesce(flag, F.lit(True)))
    return issues(
        ("category", ~(bug | other)),
        ("verifiable", wrong(verifiable)),
        ("should_go_to_esbmc", wrong(to_verifier)),
        ("expression", bug & (F.coalesce(expression, F.lit("")) == "")),
        ("expected_type", smell & (F.coalesce(expected_type, F.lit("")) != "smell")),
    )


def near_line(text: Column, expression: Column, line: Column) -> Column:
    """The expression, blanks and case aside, stands on the line or one beside it; a blank expression stands anywhere."""
    squeeze = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    start = F.greatest(line - 1, F.lit(1))
    around = F.slice(F.split(text, r"\r\n|\r|\n"), start, F.greatest(line + 2 - start, F.lit(0)))
    return (F.coalesce(expression, F.lit("")) == "") | F.exists(around, lambda x: F.contains(squeeze(x), squeeze(expression)))


def unhinted(params: Column, hints: Column) -> Column:
    """Parameters, or return, without a type hint."""
    return F.filter(F.concat(params, F.array(F.lit("return"))), lambda p: ~F.map_contains_key(hints, p))


def denied_imports(imports: Column, strict: bool = True) -> Column:
    return F.array_intersect(imports, F.array(*[F.lit(x) for x in (DENIED_STRICT if strict else DENIED)]))


def counts(rows: DataFrame, by: str = "category") -> DataFrame:
    """by, items, failures: rows with any issue."""
    return rows.groupBy(by).agg(F.count("*").alias("items"), F.count_if(F.size("issues") > 0).alias("failures"))


def top_level_execution(calls: Column, ifs: Column) -> Column:
    return (calls > 0) | (ifs > 0)


def triggerable(category: Column, risks: Column) -> Column:
    """Whether the function holds what a fault of the category needs; other categories need nothing."""
    out = F.when(category == F.lit(next(iter(RISK))), F.array_contains(risks, RISK[next(iter(RISK))]))
    for name, risk in list(RISK.items())[1:]:
        out = out.when(category == name, F.array_contains(risks, risk))
    return out.otherwise(True)


def clean_is_safe(risks: Column, has_if: Column, assert_after_exit: Column) -> Column:
    """A division needs some if in the function; an assert needs one after an if that returns."""
    return (~F.array_contains(risks, "division") | has_if) & (~F.array_contains(risks, "assert") | assert_after_exit)


def case_issues(items: DataFrame, files: DataFrame, facts: DataFrame, units: DataFrame, strict: bool = True) -> DataFrame:
    """All rules on labelled items: items with `issues`.

    items: file, function, category, verifiable, should_go_to_esbmc, expression, expected_type, line; files: file,
    text; facts: file and sources.code.file_facts(); units: file and sources.code.extract_units(). Async functions
    are no functions to these rules; of functions of one name the last counts.
    """
    own = units.where("not is_async").groupBy("file", F.col("name").alias("function")).agg(F.max_by(F.struct("parameters", "type_hints", "risks", "has_if", "assert_after_exit"), "ord").alias("u"))
    rows = items.join(facts.select("file", "ok", "imports", "top_level_calls", "top_level_ifs"), "file", "left").join(files.select("file", "text"), "file", "left").join(own, ["file", "function"], "left")
    no, clean = F.lit(False), F.col("category") == "clean"
    fault = lambda c: F.coalesce(c, no)
    parsed, there = fault(F.col("ok")), F.col("u").isNotNull()
    found = issues(
        ("file", F.col("text").isNull()), ("syntax", F.col("text").isNotNull() & ~parsed), ("function", parsed & ~there),
        ("hints", fault(F.size(unhinted(F.col("u.parameters"), F.col("u.type_hints"))) > 0)), ("top_level", fault(top_level_execution(F.col("top_level_calls"), F.col("top_level_ifs")))),
        ("imports", fault(F.size(denied_imports(F.col("imports"), strict)) > 0)), ("near_line", fault(parsed & ~clean & ~near_line(F.col("text"), F.col("expression"), F.col("line")))),
        ("triggerable", fault(there & ~triggerable(F.col("category"), F.col("u.risks")))), ("safe", fault(there & clean & ~clean_is_safe(F.col("u.risks"), F.col("u.has_if"), F.col("u.assert_after_exit")))),
    )
    shape = shape_issues(F.col("category"), F.col("verifiable"), F.col("should_go_to_esbmc"), F.col("expression"), F.col("expected_type"))
    return rows.select(*items.columns, F.concat(shape, found).alias("issues"))
