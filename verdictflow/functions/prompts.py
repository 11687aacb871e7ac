"""Prompts for an analyzer. The raw mode holds nothing that was derived from the source: no path, counts or guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .verifier import FORMAL, SMELLS

SYSTEM = f"""You examine single Python functions. For each operation that may fail, find out which values reach it,
which guards protect it, and whether some input that the function admits still makes it fail; report only such
operations. Report smells of the function apart from these.
Faults: {', '.join(FORMAL)}; they are verifiable. Smells: {', '.join(SMELLS)}; they are not.
Answer with one JSON object and nothing else: {{"findings": [...]}}, an empty list if there is nothing to report."""


def _object(**fields) -> dict:
    return {"type": "object", "additionalProperties": False, "properties": fields, "required": list(fields)}


_WORD = {"type": "string"}
#: The answer's shape, as the providers' interfaces take it: every field is required and no other is allowed.
ANSWER_SCHEMA = _object(
    findings={"type": "array", "items": _object(finding_type=_WORD | {"enum": ["suspected_bug", "smell_heuristic"]}, category=_WORD | {"enum": [*FORMAL, *SMELLS]}, explanation=_WORD, verifiable={"type": "boolean"}, metadata=_object(expression=_WORD))}
)


def assertion_lines(source: Column) -> Column:
    """Lines that assert or raise AssertionError, with their number within the function."""
    numbered = F.transform(F.split(source, "\n"), lambda x, i: F.struct((i + 1).alias("relative_line"), F.trim(x).alias("text")))
    return F.filter(numbered, lambda x: F.startswith(x["text"], F.lit("assert ")) | F.contains(x["text"], F.lit("raise AssertionError")))


def _metadata(unit: str, full: bool) -> Column:
    """What a prompt tells of a unit: its place, parameters and hints; counts of the syntax tree only if `full`."""
    c = lambda name: F.col(f"{unit}.{name}" if unit else name)
    counts = [c("line_count"), c("parameter_count"), *([c("branch_count"), c("loop_count"), c("operation_count")] if full else [])]
    return F.to_json(F.struct(c("start_line"), c("end_line"), c("parameters"), c("type_hints"), F.struct(*counts).alias("metrics")))


def _listed(items: Column) -> Column:
    return F.when(F.size(items) == 0, "- none").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def _question(unit: str) -> Column:
    c = lambda name: F.col(f"{unit}.{name}" if unit else name)
    return F.concat(F.lit("Examine the function "), c("qualname"), F.lit(" for faults that a verifier could prove, and for smells. Answer in JSON only.\n"))


def raw_prompt(unit: str = "") -> Column:
    """The prompt of a unit (columns of extract_units(), or of the struct column `unit`): name, source, parameters, hints, two sizes."""
    c = lambda name: F.col(f"{unit}.{name}" if unit else name)
    return F.concat(_question(unit), F.lit("\nSource:\n```python\n"), c("source"), F.lit("\n```\n\nAbout it: "), _metadata(unit, False))


def hints_prompt(unit: str = "") -> Column:
    """As raw_prompt(), with the operations, assertions and guards that the syntax tree shows, and all counts."""
    c = lambda name: F.col(f"{unit}.{name}" if unit else name)
    at = lambda o: F.concat(F.lit("line "), o["relative_line"].cast("string"), F.lit(": "), o["expression"])
    kind = lambda k: _listed(F.transform(F.filter(c("operations"), lambda o: o["kind"] == k), at))
    asserted = _listed(F.transform(assertion_lines(c("source")), lambda x: F.concat(F.lit("line "), x["relative_line"].cast("string"), F.lit(": "), x["text"])))
    parts = [_question(unit), F.lit("\nDivisions:\n"), kind("division"), F.lit("\nSubscripts:\n"), kind("subscript"), F.lit("\nAssertions:\n"), asserted, F.lit("\nGuards:\n"), _listed(c("guards"))]
    return F.concat(*parts, F.lit("\n\nSource:\n```python\n"), c("source"), F.lit("\n```\n\nAbout it: "), _metadata(unit, True))
