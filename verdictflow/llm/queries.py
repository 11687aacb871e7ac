"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_extract, lang_id, line_dedup, merkle, mixing, quality, search, sharding, simhash, token_files, warc
from ._shared import delete_path, scratch_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_id(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.md5("text").alias("clean_md5"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    out = warc.round_trip(table(spark, sf_dir, "pages"), path)
    delete_path(spark, path)  # all of it has been read
    return out


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_line_dedup, op4_mixing, op5_simhash, op6_sharding, op7_warc, op8_html_extract, op9_decontamination, op10_exact_dedup, op11_token_files, op12_search, op13_merkle)}

_OP3 = f"""
WITH lines AS (
  SELECT doc_id, coalesce('+' || source, '-') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents),
spread AS (SELECT trim(line) AS line, count(DISTINCT site) AS sites FROM lines WHERE trim(line) <> '' GROUP BY trim(line)),
gone AS (SELECT line FROM spread WHERE sites >= {line_dedup.MIN_SITES}),
per AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.line) AS n_removed, string_agg(lines.line, chr(10) ORDER BY pos) FILTER (WHERE gone.line IS NULL) AS kept
  FROM lines LEFT JOIN gone ON trim(lines.line) = gone.line GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS clean_chars, md5(coalesce(kept, '')) AS clean_md5
FROM per
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
n AS (SELECT page_id, body, [CAST('0x' || substr(hex, 1 + 5 * i, 5) AS BIGINT) FOR i IN range(8)] AS parts FROM p),
d AS (SELECT page_id, body, list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((parts[1 + i // 4] // (32 ** (3 - i % 4))::BIGINT) % 32 AS BIGINT), 1) FOR i IN range(32)], 'string_agg', '') AS digest FROM n),
k AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS keeper FROM d)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM k
"""

_WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
_OP9 = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]')),
ik AS (SELECT item_id, w, least(len(w), {decontamination.WORDS}) AS k FROM i),
ip AS (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM ik),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS s FROM ip),
sizes AS (SELECT item_id, count(*) AS n FROM wanted GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dp AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM d, (SELECT DISTINCT k FROM ik)),
held AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, pos, pos + k - 1), ' ') AS s FROM dp),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM held JOIN wanted USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, CAST(n AS BIGINT) AS item_shingles, shared / n AS containment
FROM hits JOIN sizes USING (item_id) WHERE shared >= n * {decontamination.CONTAINMENT} - 1e-9
"""

_OP10 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents),
size AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
m AS (SELECT r, 10 + (90 * len(terms) * n_docs) // n_terms AS m FROM d, size WHERE len(terms) > 0),
p AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(terms) AS term FROM d) GROUP BY r, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, size GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= {search.TOP}
"""


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# crc32 by its bits: SQL has no function of that name.
_BITS = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
_CRC32 = f"xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {_BITS}))"
# A sibling is written as '<' or '>' (the side on which it stands) and its hash; a run of one as '.'.
_STEPS = "[CASE WHEN {levels}[l + 1][1 + xor({place} // (2 ** l)::BIGINT, 1)] IS NULL THEN '.' WHEN ({place} // (2 ** l)::BIGINT) % 2 = 1 THEN '<' || {levels}[l + 1][{place} // (2 ** l)::BIGINT] ELSE '>' || {levels}[l + 1][2 + {place} // (2 ** l)::BIGINT] END FOR l IN range(len({levels}) - 1)]"
_UP = "[sha256(array_to_string(nodes[2 * i + 1 : 2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]"
_OP13 = f"""
WITH RECURSIVE
leaves AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
up AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_UP} FROM up WHERE len(nodes) > 1),
trees AS (SELECT lang, list(nodes ORDER BY level) AS levels FROM up GROUP BY lang),
langs AS (SELECT lang, levels, levels[len(levels)][1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM trees),
above AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM langs HAVING count(*) > 0
  UNION ALL SELECT level + 1, {_UP} FROM above WHERE len(nodes) > 1),
top AS (SELECT list(nodes ORDER BY level) AS levels, last(nodes ORDER BY level)[1] AS root FROM above),
ways AS (SELECT lang, langs.levels, subroot, root, {_STEPS.format(levels="top.levels", place="langs.place")} AS way FROM langs, top),
paths AS (
  SELECT doc_id, leaf, subroot, root, coalesce(changed, leaf) AS claimed, list_concat({_STEPS.format(levels="ways.levels", place="placed.place")}, way) AS path
  FROM placed JOIN ways ON placed.lang IS NOT DISTINCT FROM ways.lang),
folded AS (
  SELECT *, list_reduce(list_prepend(claimed, path), lambda a, x: sha256(CASE x[1] WHEN '.' THEN a WHEN '<' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([CASE WHEN x = '.' THEN '' ELSE x[2:] END FOR x IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""

ORACLES = {"op3_line_dedup": _OP3, "op7_warc": _OP7, "op9_decontamination": _OP9, "op10_exact_dedup": _OP10, "op12_search": _OP12, "op13_merkle": _OP13}
