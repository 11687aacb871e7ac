"""Roles of the driver's tables: SQL that binds them, in the subset that Spark and DuckDB share.

Only inputs are made here; operators are applied to them as DataFrames on one side and restated in SQL
on the other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CATEGORY = "CASE {} WHEN 0 THEN 'assertion_violation' WHEN 1 THEN 'division_by_zero' ELSE 'out_of_bounds' END"
_SMELL = "CASE {} WHEN 0 THEN 'long_method' WHEN 1 THEN 'many_parameters' ELSE 'complex_conditional' END"
_LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_RULES = "(" + " UNION ALL ".join(f"SELECT {i} AS rule" for i in range(1, 9)) + ")"

CASES = f"SELECT doc_id AS case_id, source AS model FROM {_LABELLED} x"
EXPECTED = f"""
SELECT doc_id AS case_id, lang AS function, source AS model, CASE kind WHEN 1 THEN {_CATEGORY.format('doc_id % 3')} WHEN 2 THEN {_SMELL.format('doc_id % 3')} ELSE 'clean' END AS category, kind = 1 AS verifiable
FROM {_LABELLED} x CROSS JOIN (SELECT 1 AS kind UNION ALL SELECT 2 AS kind UNION ALL SELECT 3 AS kind) k
WHERE (kind = 1 AND toxic = 1) OR (kind = 2 AND quality = 0) OR (kind = 3 AND quality = 1 AND toxic = 0)
"""
_FOUND = f"""
SELECT doc_id AS case_id, lang AS function, source AS model, rule,
  CASE WHEN rule IN (1, 2, 6, 8) THEN {_CATEGORY.format('doc_id % 3')} WHEN rule = 3 THEN {_CATEGORY.format('(doc_id + 1) % 3')}
    WHEN rule = 4 THEN {_SMELL.format('doc_id % 3')} WHEN rule = 5 THEN {_SMELL.format('(doc_id + 1) % 3')} ELSE 'style' END AS category,
  CASE WHEN rule IN (1, 2, 3, 8) THEN 'suspected_bug' WHEN rule IN (4, 5) THEN 'smell_heuristic' WHEN rule = 6 THEN 'llm_false_positive' ELSE 'out_of_scope_finding' END AS finding_type,
  rule <= 3 AS verifiable
FROM {_LABELLED} x CROSS JOIN {_RULES} r
WHERE (rule = 1 AND toxic = 1 AND doc_id % 4 <> 0) OR (rule = 2 AND toxic = 1 AND doc_id % 7 = 0) OR (rule = 3 AND doc_id % 5 = 0) OR (rule = 4 AND quality = 0 AND doc_id % 3 <> 0)
  OR (rule = 5 AND n_chars < 300) OR (rule = 6 AND doc_id % 9 = 0) OR (rule = 7 AND doc_id % 11 = 0) OR (rule = 8 AND doc_id % 13 = 0)
"""
FINDINGS = f"""
SELECT f.*, CASE WHEN NOT verifiable THEN NULL WHEN (case_id + rule) % 6 <= 1 THEN 'violation_found' WHEN (case_id + rule) % 6 = 2 THEN 'no_violation_found' WHEN (case_id + rule) % 6 = 3 THEN 'skipped' WHEN (case_id + rule) % 6 = 4 THEN 'inconclusive' ELSE 'tool_error' END AS status,
  CASE WHEN case_id % 5 = 4 THEN 'unknown_esbmc_violation' ELSE category END AS property
FROM ({_FOUND}) f
"""
DIRECT = f"""
SELECT doc_id AS case_id, lang AS function, source AS model,
  CASE WHEN doc_id % 3 = 2 THEN 'skipped' WHEN toxic = 1 OR doc_id % 17 = 0 THEN 'violation_found' ELSE 'no_violation_found' END AS status,
  CASE WHEN toxic = 1 AND doc_id % 5 <> 1 THEN {_CATEGORY.format('doc_id % 3')} WHEN toxic = 1 THEN 'unknown_esbmc_violation' ELSE 'assertion_violation' END AS property
FROM {_LABELLED} x
"""

_N = "chr(10)"
_KIND = "CASE event_id % 6 WHEN 0 THEN 'assertion' WHEN 1 THEN 'division by zero' WHEN 2 THEN 'array bounds violated' WHEN 3 THEN 'dereference failure: invalid pointer' WHEN 4 THEN 'IndexError raised' ELSE 'memory leak' END"
_PLACE = "'file user_' || CAST(user_id AS VARCHAR(20)) || '.py line ' || CAST(event_id % 90 AS VARCHAR(20)) || ' column 4 function f' || CAST(event_id % 7 AS VARCHAR(20))"
_LATER = "'file user_' || CAST(user_id AS VARCHAR(20)) || '.py line ' || CAST(event_id % 80 AS VARCHAR(20)) || ' column 4 function h' || CAST(event_id % 5 AS VARCHAR(20))"
RUNS = f"""
SELECT event_id, user_id, 'user_' || CAST(user_id AS VARCHAR(20)) || '_violation.py' AS file, 'f' || CAST(event_id % 7 AS VARCHAR(20)) AS function, event_id AS ord,
  CASE WHEN event_type = 'error' THEN 'Generated ' || CAST(event_id % 4 AS VARCHAR(20)) || ' VCC(s), 1 remaining' || {_N} || 'State 1 ' || {_PLACE} || ' thread 0' || {_N} || 'x=' || CAST(event_id AS VARCHAR(20)) || ' (0x1)' || {_N} || 'item = 3' || {_N} || '  y  =  2 (0x2)' || {_N}
      || 'x = ' || CAST(event_id AS VARCHAR(20)) || ' (0x9)' || {_N} || 'a=1' || {_N} || 'l = 2' || {_N} || 'b =2' || {_N} || 'c= 3' || {_N} || 'd = 4' || {_N} || 'e = 5' || {_N} || {_N} || 'Violated property:' || {_N} || CASE WHEN event_id % 3 = 0 THEN '' ELSE '  ' || {_LATER} || {_N} END || '  ' || {_KIND} || {_N} || '  x != 0' || {_N} || {_N} || 'VERIFICATION FAILED'
    WHEN event_type = 'view' THEN 'a.py:3: SyntaxWarning: odd literal' || {_N} || 'b.py:9: SyntaxWarning:  ' || {_N} || 'Generated ' || CAST(event_id % 3 AS VARCHAR(20)) || ' VCCs' || {_N} || 'VERIFICATION SUCCESSFUL'
    WHEN event_type = 'click' THEN CASE event_id % 3 WHEN 0 THEN 'ERROR: Cannot open file x' WHEN 1 THEN 'ERROR: feature not supported' ELSE 'ERROR: crashed' END
    ELSE '' END AS stdout,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS returncode
FROM events
"""
_ID = "CASE WHEN turn % 3 = 0 THEN '' ELSE 'B' || CAST(turn % 2 AS VARCHAR(20)) END"
_JSON = (
    "'{\"findings\": [{\"id\": \"' || " + _ID + " || '\", \"category\": \"' || CASE turn % 4 WHEN 0 THEN 'assertion_violation' WHEN 1 THEN 'division_by_zero' WHEN 2 THEN 'long_method' ELSE 'naming' END || '\", \"verifiable\": '"
    " || CASE WHEN turn % 2 = 0 THEN 'True' ELSE 'false' END || ', \"metadata\": {\"expression\": \"' || role || ' / 4\", \"line\": \"' || CASE WHEN turn % 5 = 0 THEN 'x' ELSE CAST(turn AS VARCHAR(20)) END || '\"}}]}'"
)
RESPONSES = f"""
SELECT conv_id, turn, role, {_ID} AS raw_id, {_JSON} AS body,
  CASE conv_id % 4 WHEN 0 THEN {_JSON} WHEN 1 THEN '<think>{{"a": None}}' || {_N} || 'hm</think>' || {_JSON} WHEN 2 THEN '```json' || {_N} || {_JSON} || {_N} || '```' ELSE '  ' || {_JSON} || ' That is all.' END AS response
FROM conversations
"""

# One unit of Python for each conversation row, in three shapes, and a response of three findings about it.
UNIT_SOURCES = (
    "def f(a: int, b: int) -> int:\n    if b != 0:\n        return a // b\n    return a % 7\n",
    "def g(rows: list, i: int) -> int:\n    assert i >= 0\n    if i < len(rows):\n        return rows[i]\n    return rows[0] / i\n",
    "def h(n: int) -> int:\n    for k in range(n):\n        n = n - k\n    return n\n",
)
CHOICES = (
    ("division_by_zero", "a // b", "true"), ("division_by_zero", "a % 7", "true"), ("division_by_zero", "", "true"), ("out_of_bounds", "rows[i]", "true"), ("out_of_bounds", "len(rows)", "true"),
    ("assertion_violation", "assert i>=0", "true"), ("assertion_violation", "i < len", "true"), ("assertion_violation", "", "true"), ("division_by_zero", "rows[0]/i", "true"), ("division_by_zero", "a%7", "true"),
    ("long_method", "x", "true"), ("naming", "x", "true"), ("out_of_bounds", "rows[i]", "false"), ("assertion_violation", "k > 0", "true"),
)
_text = lambda t: "'" + f"' || {_N} || '".join(t.split("\n")) + "'"
_pick = lambda j, i: f"CASE (conv_id + turn * 3 + {j}) % {len(CHOICES)} " + " ".join(f"WHEN {k} THEN '{c[i]}'" for k, c in enumerate(CHOICES)) + " END"
#: The id that finding j of a response gives: two that repeat, a blank one, and an empty one.
_given = lambda j: f"CASE (turn + {j}) % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'B' WHEN 2 THEN ' ' ELSE '' END"
_told = lambda j: f"""'{{"id": "' || {_given(j)} || '", "finding_type": "suspected_bug", "category": "' || {_pick(j, 0)} || '", "verifiable": ' || {_pick(j, 2)} || ', "metadata": {{"expression": "' || {_pick(j, 1)} || '", "line": 1}}}}'"""
_KEY = "CAST(conv_id AS VARCHAR(20)) || ':' || CAST(turn AS VARCHAR(20))"
UNITS = f"SELECT conv_id, turn, {_KEY} || '.py' AS path, CASE conv_id % 3 " + " ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(UNIT_SOURCES[:2])) + f" ELSE {_text(UNIT_SOURCES[2])} END AS text FROM conversations"
UNIT_RESPONSES_OF = f"SELECT conv_id, turn, {_KEY} || '.py::0::' || CASE conv_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' ELSE 'h' END AS unit_key, '<think>well</think>{{\"findings\": [' || {_told(0)} || ', ' || {_told(1)} || ', ' || {_told(2)} || ']}} So much for that.' AS response FROM conversations"
UNIT_RESPONSES = f"SELECT unit_key, response FROM ({UNIT_RESPONSES_OF}) r"
#: Runs of the units' functions; every fifth has no output.
UNIT_RUNS = f"""
SELECT {_KEY} || '.py' AS file, CASE conv_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' ELSE 'h' END AS function,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'Violated property:' || {_N} || '  division by zero' || {_N} || '  b != 0' || {_N} || {_N} || 'VERIFICATION FAILED' WHEN 1 THEN 'Violated property:' || {_N} || '  array bounds violated' || {_N} || {_N} || 'VERIFICATION FAILED'
    WHEN 2 THEN 'VERIFICATION SUCCESSFUL' WHEN 3 THEN 'ERROR: crashed' END AS stdout, 1 AS returncode
FROM conversations
"""
#: Cases of the units: their number, file, and whether it could be read; and what is expected in them.
_CASE = "conv_id * 1000 + turn"
_FUNCTION = "CASE conv_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'g' ELSE 'h' END"
UNIT_CASES = f"SELECT {_CASE} AS case_id, {_KEY} || '.py' AS file, CASE WHEN conv_id % 11 = 10 THEN 'missing' WHEN conv_id % 13 = 12 THEN 'failed' ELSE 'ok' END AS status FROM conversations"
#: The same cases as they are known before an answer is read, and the attempts at their units: of some files the first answers are of no use, of some all.
FOUND_CASES = f"SELECT case_id, file, CASE WHEN status = 'missing' THEN status ELSE 'ok' END AS status FROM ({UNIT_CASES}) c"
_TRY = "(SELECT 1 AS attempt UNION ALL SELECT 2 AS attempt UNION ALL SELECT 3 AS attempt)"
_BAD = "CASE WHEN conv_id % 13 = 12 THEN 3 WHEN conv_id % 7 = 3 THEN 2 WHEN conv_id % 5 = 1 THEN 1 ELSE 0 END"
_USELESS = "CASE (conv_id + turn + attempt) % 4 WHEN 0 THEN NULL WHEN 1 THEN '{\"findings\": {\"id\": 1}}' WHEN 2 THEN 'I cannot say.' ELSE '{\"findings\": [' END"
UNIT_ATTEMPTS = f"""
SELECT unit_key, attempt, CASE WHEN attempt <= bad THEN useless ELSE response END AS response
FROM (SELECT r.*, attempt, {_BAD} AS bad, {_USELESS} AS useless FROM ({UNIT_RESPONSES_OF}) r CROSS JOIN {_TRY} a) x WHERE attempt <= bad + 1
"""
UNIT_EXPECTED = f"""
SELECT {_CASE} AS case_id, {_FUNCTION} AS function, CASE conv_id % 3 WHEN 0 THEN 'division_by_zero' ELSE 'out_of_bounds' END AS category, TRUE AS verifiable FROM conversations WHERE conv_id % 3 <> 2 AND turn % 4 <> 3
UNION ALL SELECT {_CASE}, {_FUNCTION}, 'long_method', FALSE FROM conversations WHERE turn % 4 = 1
UNION ALL SELECT {_CASE}, {_FUNCTION}, 'clean', FALSE FROM conversations WHERE turn % 4 = 3
"""

#: Values of any type where a response should have a text, a list, a number or a truth value.
ODD = ('"yes"', '"false"', '""', "1", "0", "true", "false", "null", "[]", '["a",1,null,{"b":true}]', "{}", '{"k":1}', "2.5", '"7"', '" 12 "', '"7.5"', "-3.9")
_odd = lambda k: f"CASE (conv_id * 31 + turn * {2 * k + 1} + {k}) % {len(ODD) + 1} " + " ".join(f"WHEN {i} THEN '{{name}}{v}'" for i, v in enumerate(ODD)) + " ELSE '' END"


def _odd_field(name: str, k: int) -> str:
    return _odd(k).replace("{name}", f', "{name}": ')


ODD_RESPONSES = f"""
SELECT conv_id, turn, CAST(conv_id AS VARCHAR(20)) || ':' || CAST(turn AS VARCHAR(20)) AS unit_key,
  '{{"findings": [{{"stage": "s"' || {_odd_field("verifiable", 0)} || {_odd_field("id", 1)} || {_odd_field("evidence", 2)} || {_odd_field("explanation", 3)} || {_odd_field("expected_exception", 4)}
  || CASE turn % 5 WHEN 0 THEN ', "metadata": [1]' ELSE ', "metadata": {{"at": 0' || {_odd_field("expression", 5)} || {_odd_field("line", 6)} || '}}' END || '}}]}}' AS response
FROM conversations
"""

# Whole source files, one for each conversation row: a module with a method, a nested and an asynchronous function, one that
# breaks rules of labelled data, and one that is no Python. Blank lines above, a literal ($d) and names ($t) follow the row.
_SHARE = """import math


def share_$t(total: int, parts: int) -> int:
    return total // parts


def pick(rows: list[int], at: int) -> int:
    if at < len(rows):
        return rows[at]
    return rows[0] / $d


class Box:
    def main(self, n: int) -> float:
        def inner(k: int) -> int:
            assert k > 0
            return $d % k

        for i in range(n):
            inner(i)
        return math.sqrt(n)


async def later(k: int) -> int:
    while k > $d:
        k = k - 1
    return k


def main() -> None:
    share_$t(1, 2)


def test_share() -> None:
    assert share_$t(4, 2) == 2
"""
_LOOSE = """import numpy


def loose(a, b: int):
    if b < $d:
        return 0
    assert b >= 0
    return a


print(loose(1, 2))
"""
KIND = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'share' WHEN 1 THEN 'share' WHEN 4 THEN 'broken' ELSE 'loose' END"
SHIFT = "CAST((conv_id * 7 + turn) % 6 AS INTEGER)"
LITERAL = "CAST(conv_id % 8 + 2 AS VARCHAR(20))"
TURN_OF_ELEVEN = "(conv_id + turn * 3) % 11"
_filled = lambda text: f"replace(replace({text}, '$d', {LITERAL}), '$t', CAST(turn AS VARCHAR(20)))"
_of_eleven = lambda *texts: f"CASE {TURN_OF_ELEVEN} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END"
#: What a file's units are asked for.
ASKED = _filled(_of_eleven("total//parts", "rows[ at ]", "k>0", "assert k > 0", "len(rows)", "list[int]", "b>=0", "assert b >= 0", "rows[0]/$d", "", "1 +"))
SOURCES = f"SELECT 'src/' || {_KEY} || '.py' AS path, repeat({_N}, {SHIFT}) || {_filled(f'CASE {KIND} ' + f"WHEN 'share' THEN {_text(_SHARE)} WHEN 'loose' THEN {_text(_LOOSE)} ELSE 'def broken(:' END")} AS text, {ASKED} AS expression FROM conversations"
DIVISIONS = f"SELECT conv_id, turn, {_filled(_of_eleven('a + b / $d', 'f(a / $d', 'x / $de3', 'x // 1_00$d', 'x / 0x1$d', 'x % 0', 'x / -$d', 'x / y', 'x * $d', 'x / $d', '$d % k'))} AS expression FROM conversations"
#: Labelled items about these files, and the ground-truth file that holds each: flags, files and lines are wrong or missing here and there.
_NAMED = "CASE asked WHEN 'share' THEN CASE turn % 4 WHEN 0 THEN CASE WHEN conv_id % 6 = 5 THEN 'clean' ELSE 'division_by_zero' END WHEN 1 THEN 'division_by_zero' WHEN 2 THEN CASE WHEN conv_id % 4 = 1 THEN 'assertion_violation' ELSE 'out_of_bounds' END ELSE 'clean' END WHEN 'loose' THEN CASE WHEN conv_id % 2 = 0 THEN 'clean' ELSE 'assertion_violation' END ELSE 'clean' END"
LABELLED_ITEMS = f"""
SELECT conv_id, turn, CASE conv_id % 2 WHEN 0 THEN 'data/ground_truths/bugs' ELSE 'data/set_b' END || '/out_of_bounds_' || CAST(conv_id AS VARCHAR(20)) || '.json' AS json_path, CASE conv_id % 3 WHEN 0 THEN 'division_by_zero' WHEN 2 THEN 'clean' END AS told_category,
  'i' || {_KEY} AS id, CASE turn % 6 WHEN 4 THEN '' WHEN 5 THEN 'lost_' ELSE '' END || CASE WHEN turn % 6 = 4 THEN '' ELSE {_KEY} || '.py' END AS file,
  CASE asked WHEN 'share' THEN CASE turn % 4 WHEN 0 THEN 'share_' || CAST(turn AS VARCHAR(20)) WHEN 1 THEN 'inner' WHEN 2 THEN 'pick' ELSE 'later' END ELSE asked END AS function,
  CASE WHEN turn % 3 <> 2 THEN named END AS expected_category, CASE WHEN turn % 3 = 2 THEN named END AS category, named <> 'clean' AS verifiable, CASE WHEN turn % 7 <> 6 THEN named <> 'clean' END AS should_go_to_esbmc,
  CASE WHEN named = 'clean' THEN '' WHEN asked = 'loose' THEN 'b >= 0' WHEN turn % 4 = 0 THEN 'total // parts' WHEN turn % 4 = 1 THEN {LITERAL} || ' % k' ELSE 'rows[0]' END AS expression,
  CASE WHEN named = 'clean' THEN 0 WHEN (conv_id + turn) % 7 = 3 THEN 99 ELSE CASE WHEN asked = 'loose' THEN 7 WHEN turn % 4 = 0 THEN 5 WHEN turn % 4 = 1 THEN 18 ELSE 11 END + {SHIFT} + conv_id % 2 END AS line,
  CASE WHEN named = 'clean' THEN '' ELSE 'Error' END AS expected_type
FROM (SELECT *, {_NAMED} AS named FROM (SELECT *, {KIND} AS asked FROM conversations) a) b
"""
#: Rows of people's reports, one for each finding.
REPORT_ROWS = f"""
SELECT case_id, model, 'a/b/' || CAST(case_id AS VARCHAR(20)) || '.py' AS path, rule, CASE WHEN rule = 6 THEN 'esbmc_direct' ELSE 'llm_analysis' END AS stage, function, category, CASE WHEN rule <> 5 THEN 'x' || CAST(rule AS VARCHAR(20)) || ' / y' END AS expression, CASE WHEN rule = 7 THEN 0 ELSE case_id % 50 + rule END AS line,
  CASE WHEN finding_type = 'llm_false_positive' THEN finding_type WHEN finding_type = 'suspected_bug' AND status = 'violation_found' THEN 'llm_confirmed_by_esbmc' WHEN finding_type = 'suspected_bug' THEN 'not_confirmed_within_bound' ELSE 'out_of_scope_finding' END AS final_class,
  CASE WHEN rule % 2 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN rule % 3 <> 0 THEN 'why ' || CAST(rule AS VARCHAR(20)) END AS reasoning, 'told ' || CAST(rule AS VARCHAR(20)) AS interpretation
FROM ({FINDINGS}) f
"""

_TABLES = re.compile(r"\b(documents|labels|events|conversations|lineitem)\b")


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a role: `sql` with the names of the driver's tables read as their files, so that no view is made."""
    return spark.sql(_TABLES.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))
