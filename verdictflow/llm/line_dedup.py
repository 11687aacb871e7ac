"""Removal of boilerplate lines by the spread of each line over distinct sites (DataFrame functions only).

Each line hash gets a HyperLogLog sketch of the sites that it appears on; sketches are built before the
shuffle and merged after it, so a hot line is one row for each map task. An estimate well above the
threshold decides at once, one well below it clears the line, and lines near it get an exact distinct
count. Lines on at least `min_sites` sites are boilerplate and go from every document.

Defined results: lines are split at \\n and compared without leading and trailing spaces; blank lines
are never boilerplate and stay; null text gives null text and no lines; a null site counts as one
site; null ids and repeated rows are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import attach, cut

MIN_SITES = 8
LG_K = 12
#: Sketches of LG_K 12 err by 1.6 % at one standard error; the band is over six of them, and two sites at least.
BAND = 0.1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """96 bits of hash of a trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h"), F.hash(F.trim(line)).alias("g"))


def line_sites(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row for each non-blank line and occurrence: key (h, g), site, its text's key (t, b) and its place in the text, pos."""
    text = F.col(text_col)
    rows = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("t"), F.octet_length(text).alias("b"), F.coalesce(F.concat(F.lit("+"), F.col(site_col).cast("string")), F.lit("-")).alias("site"), F.explode(F.filter(F.transform(_lines(text), lambda x, i: F.when(F.trim(x) != "", F.struct(_key(x).alias("k"), i.alias("pos")))), lambda x: x.isNotNull())).alias("x"))
    return rows.select("t", "b", "site", "x.k.h", "x.k.g", "x.pos")


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The keys (h, g) of lines on at least min_sites distinct sites."""
    margin = max(2.0, BAND * min_sites)
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = cut(lines.groupBy("h", "g").agg(estimate.alias("sites")).where(F.col("sites") >= min_sites - margin))
    sure = spread.where(F.col("sites") > min_sites + margin).select("h", "g")
    near = spread.where(F.col("sites") <= min_sites + margin).select("h", "g")
    exact = attach(lines.select("h", "g", "site"), near, ["h", "g"], None, "left_semi").groupBy("h", "g").agg(F.count_distinct("site").alias("n"))
    return cut(sure.unionByName(exact.where(F.col("n") >= min_sites).select("h", "g")))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, text without boilerplate lines, n_lines, n_removed."""
    lines = line_sites(docs, text_col, site_col)
    found = boilerplate(lines, min_sites)
    # Of copies of a text, the places are the same: a set of them is as long as the text has lines.
    hits = attach(lines.select("h", "g", "t", "b", "pos"), found, ["h", "g"], None, "left_semi").groupBy("t", "b").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"), F.octet_length(text_col).alias("b"))
    out = attach(rows, hits, ["t", "b"]).withColumn("lines", _lines(F.col("text")))
    # array_except keeps the order of what stays, and takes time in proportion to both.
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get("lines", i)))).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)))
    changed = F.col("gone").isNotNull()
    return out.select("doc_id", F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("text")).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.when(changed, F.col("n_lines") - F.size("kept")).otherwise(0).cast("long").alias("n_removed"))
