"""Analyzer responses and findings: JSON clean-up, defaults and source checks as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .verifier import FORMAL, SMELLS, has

#: A finding as parse_response() gives it: texts that Python calls false are null, so that defaults can take their place.
FINDING = "id string, stage string, finding_type string, category string, title string, explanation string, evidence array<string>, verifiable boolean, confidence string, expected_exception string, metadata struct<expression:string,line:string,relative_line:string>"
_FINDINGS = f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in FINDING.split(', '))}>>"


_SCALAR = r'^(?:"(?:[^"\\]++|\\.)*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)'


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _first_value_end(text: Column) -> Column:
    """Length of the JSON object or array that opens the text; null if none does or it never closes.

    Strings (with their escapes) are matched whole, so brackets inside them do not count. The text is cut into
    strings and single brackets, and a running depth finds where the first value closes.
    """
    parts = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[\[\]{}]|[^"\[\]{}]++|"'), F.lit(0))
    step = lambda x: F.when(x.isin("{", "["), 1).when(x.isin("}", "]"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def walk(state: Column, x: Column) -> Column:
        depth, at = state["depth"] + step(x), state["at"] + F.length(x)
        closed = state["end"].isNull() & (depth == 0) & (step(x) == -1)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(closed, at).otherwise(state["end"]).alias("end"))

    return F.when(F.rlike(text, F.lit(r"^[\[{]")), F.aggregate(parts, start, walk)["end"])


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_value(text: Column) -> Column:
    """The JSON value that the text begins with; the whole text if it begins with none."""
    scalar = F.regexp_extract(text, _SCALAR, 0)
    nested = F.substr(text, F.lit(1), _first_value_end(text))
    return F.when(F.rlike(text, F.lit(r"^[\[{]")), _bound(nested, lambda x: F.when(F.try_parse_json(x).isNotNull(), x).otherwise(text))).when(scalar != "", scalar).otherwise(text)


def _unfenced(text: Column) -> Column:
    inner = stripped(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"(?:^|\n)[ \t]*```\s*$", ""))
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def clean_json(text: Column) -> Column:
    """Drop think blocks, code fences and what follows the first JSON value; Python literals become JSON ones (inside strings too)."""
    out = stripped(F.regexp_replace(stripped(text), r"(?s)<think>.*?</think>", ""))
    for word, to in (("True", "true"), ("False", "false"), ("None", "null")):
        out = F.regexp_replace(out, rf"\b{word}\b", to)
    return _bound(_bound(out, _unfenced), _first_value)


def _kind(value: Column) -> Column:
    """VOID, BOOLEAN, STRING, BIGINT, DECIMAL(..), DOUBLE, ARRAY<..> or OBJECT<..>; null where there is no value."""
    return F.schema_of_variant(value)


def truth(value: Column) -> Column:
    """The truth value that Python gives a JSON value: blank texts, zeros, empty lists and objects, and null are false."""
    kind, json = _kind(value), F.to_json(value)
    known = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
    known = known.when(F.startswith(kind, F.lit("ARRAY")), json != "[]").when(F.startswith(kind, F.lit("OBJECT")), json != "{}")
    return F.coalesce(known.when(kind != "VOID", F.try_variant_get(value, "$", "double") != 0), F.lit(False))


def text_of(value: Column) -> Column:
    """A JSON value as text: literals as Python writes them, numbers, lists and objects as JSON; null where there is no value."""
    kind = _kind(value)
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(F.to_json(value))).otherwise(F.try_variant_get(value, "$", "string"))


def whole_number(value: Column) -> Column:
    """A number without its fraction, a text that is an integer, true and false as 1 and 0; null for anything else."""
    kind, text = _kind(value), stripped(F.try_variant_get(value, "$", "string"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "int")).when(kind == "STRING", text.try_cast("int"))
    return number.when(F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")), F.try_variant_get(value, "$", "double").try_cast("int"))


def evidence_list(value: Column) -> Column:
    """A JSON list gives its elements as texts, any other value one element, no value none."""
    listed = F.transform(F.try_variant_get(value, "$", "array<variant>"), text_of)
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.startswith(_kind(value), F.lit("ARRAY")), listed).otherwise(F.array(text_of(value)))


def _finding(f: Column) -> Column:
    at = lambda path: F.try_variant_get(f, f"$.{path}", "variant")
    said = lambda name: F.when(truth(at(name)), text_of(at(name))).alias(name)
    number = lambda name: whole_number(at(f"metadata.{name}")).cast("string").alias(name)
    metadata = F.struct(text_of(at("metadata.expression")).alias("expression"), number("line"), number("relative_line"))
    return F.struct(*[said(c) for c in ("id", "stage", "finding_type", "category", "title", "explanation")], evidence_list(at("evidence")).alias("evidence"), truth(at("verifiable")).alias("verifiable"), said("confidence"), text_of(at("expected_exception")).alias("expected_exception"), metadata.alias("metadata"))


def findings_of(text: Column) -> Column:
    """The findings array of a response as variants; null where there is none. An object that repeats a key cannot be read."""
    return F.try_variant_get(F.try_parse_json(clean_json(text)), "$.findings", "array<variant>")


def parse_response(text: Column) -> Column:
    """The findings array, whatever the types of its fields; null where the response has none. Prose after the JSON value is ignored."""
    return F.transform(findings_of(text), _finding)


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def safe_int(value: Column) -> Column:
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(0))


def unique_id(finding_id: Column, repeat: Column, position: Column) -> Column:
    """A repeated id within a unit gets its 1-based position as a suffix; repeat counts it from 1."""
    return F.when(repeat > 1, F.concat(finding_id, F.lit(":"), position.cast("string"))).otherwise(finding_id)


_BLOCKS = "array<struct<type:string,text:string>>"
_ENVELOPE = f"struct<output:array<struct<content:{_BLOCKS}>>,content:{_BLOCKS},choices:array<struct<message:struct<content:string>>>>"


def _block_text(blocks: Column, *kinds: str) -> Column:
    """Text of the first block of one of the kinds; other blocks, such as reasoning, are passed over."""
    told = F.filter(blocks, lambda x: x["type"].isin(*kinds) & (F.coalesce(x["text"], F.lit("")) != ""))
    return F.get(told, F.lit(0))["text"]


def envelope_text(raw: Column) -> Column:
    """The answer in a provider's envelope, of the responses, messages or chat layout; null without one."""
    e, short = F.from_json(raw, _ENVELOPE), F.try_variant_get(F.try_parse_json(raw), "$.output_text", "variant")
    nested = F.flatten(F.transform(e["output"], lambda o: F.coalesce(o["content"], F.array().cast(_BLOCKS))))
    return F.coalesce(F.when(_kind(short) == "STRING", text_of(short)), _block_text(nested, "output_text", "text"), _block_text(e["content"], "text"), F.nullif(F.get(e["choices"], F.lit(0))["message"]["content"], F.lit("")))


def chat_findings(raw: Column) -> Column:
    """Findings of a chat layout, where an answer that is empty or cannot be read has none."""
    return F.coalesce(parse_response(F.get(F.from_json(raw, _ENVELOPE)["choices"], F.lit(0))["message"]["content"]), F.array().cast(_FINDINGS))


def operation_kind(category: Column) -> Column:
    return F.when(category == "division_by_zero", "division").when(category == "out_of_bounds", "subscript")


def guarded_division(expression: Column, guards: Column) -> Column:
    """What follows the first operator found, in the order //, /, %, occurs in a guard."""
    after = lambda op: stripped(F.substr(expression, F.instr(expression, op) + len(op)))
    divisor = F.when(has(expression, "//"), after("//")).when(has(expression, "/"), after("/")).when(has(expression, "%"), after("%"))
    return F.coalesce((divisor != "") & F.exists(guards, lambda g: F.contains(g, divisor)), F.lit(False))


def guarded_index(expression: Column, guards: Column) -> Column:
    """What stands between the first [ and the last ] occurs in a guard."""
    index = stripped(F.regexp_extract(expression, r"(?s)^[^\[]*\[(.*)\]", 1))
    return F.coalesce((index != "") & F.exists(guards, lambda g: F.contains(g, index)), F.lit(False))


def guard_covers(category: Column, expression: Column, guards: Column) -> Column:
    return F.when(category == "division_by_zero", guarded_division(expression, guards)).when(category == "out_of_bounds", guarded_index(expression, guards)).otherwise(False)


def normal_form(finding_type: Column, category: Column, verifiable: Column, assertion_found: Column, operation_found: Column, expression_found: Column, constant: Column) -> Column:
    """The decision table of finding normalization: struct(rule, finding_type, verifiable). The first rule wins."""
    rows = (
        ("N1", ~category.isin(*FORMAL, *SMELLS), F.lit("out_of_scope_finding"), False),
        ("N2", verifiable & (category == FORMAL[0]) & assertion_found, F.lit("suspected_bug"), True),
        ("N3", verifiable & (category == FORMAL[0]), F.lit("llm_false_positive"), False),
        ("N4", verifiable & category.isin(*SMELLS), F.lit("smell_heuristic"), False),
        ("N5", verifiable & operation_found & constant, F.lit("llm_false_positive"), False),
        ("N6", verifiable & operation_found, F.lit("suspected_bug"), True),
        ("N7", verifiable & expression_found & constant, F.lit("llm_false_positive"), False),
        ("N8", verifiable & expression_found, F.lit("suspected_bug"), True),
        ("N9", verifiable, F.lit("llm_false_positive"), False),
    )
    row = lambda name, kind, v: F.struct(F.lit(name).alias("rule"), kind.alias("finding_type"), F.lit(v).alias("verifiable"))
    out = F.when(rows[0][1], row("N1", rows[0][2], False))
    for name, when, kind, v in rows[1:]:
        out = out.when(when, row(name, kind, v))
    return out.otherwise(row("N10", finding_type, False))


# Model aliases, default models of backends, and display names.
ALIASES = {"claude": "claude-3-7-sonnet-20250219", "gpt": "gpt-4o", "gemini": "gemini-3.1-flash-lite", "deepseek": "deepseek-r1:7b"}
DEFAULT_MODELS = {"openai": "gpt-4o", "anthropic": "claude-sonnet-4-6", "ollama": "deepseek-r1:7b", "google": "gemini-3.1-flash-lite"}
SHORT_NAMES = {"gpt-4o": "GPT-4o", "claude-3-7-sonnet-20250219": "Claude 3.7 Sonnet", "deepseek-r1:7b": "DeepSeek-R1 Distill-Qwen-7B", "deepseek": "DeepSeek-R1 Distill-Qwen-7B"}


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def backend_of(model: Column) -> Column:
    """The provider that a model's name tells; openai if there is no name."""
    low = F.lower(model)
    named = F.when(has(low, "claude"), "anthropic").when(has(low, "gemini"), "google").when(has(low, "gpt") | has(low, "o1") | has(low, "o3") | has(low, "o4"), "openai").otherwise("ollama")
    return F.when(model.isNull(), "openai").otherwise(named)


def resolve_model(model: Column, backend: Column | None = None) -> Column:
    """The full name of an alias; without a name, the default of the backend if one is given."""
    out = F.coalesce(_looked_up(F.lower(model), ALIASES), model)
    return out if backend is None else F.coalesce(F.nullif(out, F.lit("")), _looked_up(backend, DEFAULT_MODELS))


def safe_name(label: Column) -> Column:
    """A label as part of a file name: other characters than letters, digits, - and _ become _, outer ones go."""
    kept = F.regexp_replace(F.regexp_replace(label, r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.when(kept == "", "model").otherwise(kept)


def short_name(label: Column) -> Column:
    last = F.element_at(F.split(label, "/"), -1)
    return F.coalesce(_looked_up(last, SHORT_NAMES), last)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_script(text: Column) -> Column:
    return F.replace(text, F.lit("</"), F.lit("<\\/"))


def fixed(value: Column, digits: int = 4) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.round(value, digits))).otherwise("N/A")


def row_key(*parts: Column) -> Column:
    """Parts joined by ::, blanks kept."""
    return F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
