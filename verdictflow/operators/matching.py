"""One-to-one matching of findings and expectations, by counting.

The match predicate is equality of keys, so greedy one-to-one matching equals counting per key: both
sides are aggregated before one full outer join, and no key's rows ever meet in one task. Where it matters which
finding met which expectation, match_rows() joins them by key and rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["case_id", "category", "function"]


def match_counts(found: DataFrame, expected: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, tp, fp, fn."""
    g = found.groupBy(*keys).agg(F.count("*").alias("g"))
    e = expected.groupBy(*keys).agg(F.count("*").alias("e"))
    g0, e0 = F.coalesce("g", F.lit(0)), F.coalesce("e", F.lit(0))
    joined = g.join(e, keys, "full")
    return joined.select(*keys, F.least(g0, e0).alias("tp"), F.greatest(g0 - e0, F.lit(0)).alias("fp"), F.greatest(e0 - g0, F.lit(0)).alias("fn"))


def match_verdicts(found: DataFrame, expected: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row for each verdict: keys, verdict, n (its number within key and verdict, from 1)."""
    each = match_counts(found, expected, keys)
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("k")) for v in ("tp", "fp", "fn")]))
    rows = each.select(*keys, named.alias("x")).where("x.k > 0")
    return rows.select(*keys, "x.verdict", F.explode(F.sequence(F.lit(1), F.col("x.k").cast("int"))).alias("n"))


def missed(baseline: DataFrame, found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Multiset difference: keys, missed > 0."""
    return match_counts(found, baseline, keys).where("fn > 0").select(*keys, F.col("fn").alias("missed"))


def ranked(rows: DataFrame, keys: list[str], order: str, parts: int = 32) -> DataFrame:
    """rows with `rank`, from 1 within a key, by the number `order`, which should be distinct within a key.

    The numbers are cut into ranges between quantiles and each key's rows are ranked range by range; counts of the
    ranges before give the rest. So the rows of a hot key are ranked by many tasks.
    """
    cuts = sorted(set(rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", part)
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))
    out = ranged.withColumn("_local", local).join(starts, [*keys, "_part"], "left")
    return out.withColumn("rank", (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("long")).drop("_part", "_n", "_before", "_local")


def match_rows(found: DataFrame, expected: DataFrame, keys: list[str] = KEYS, found_order: str = "pos", expected_order: str = "ord") -> DataFrame:
    """Which finding meets which expectation: keys, verdict, rank, found and expected (structs of the sides' other columns, null where there is none).

    Expectations are taken in their order, each meeting the first finding of its key that is left: that is the one of
    the same rank. Rows with a null in their key meet nothing and are false positives or negatives each.
    """
    side = lambda rows, order, name: ranked(rows, keys, order).select(*keys, "rank", F.struct(*[c for c in rows.columns if c not in keys]).alias(name))
    joined = side(found, found_order, "found").join(side(expected, expected_order, "expected"), [*keys, "rank"], "full")
    verdict = F.when(F.col("expected").isNull(), "fp").when(F.col("found").isNull(), "fn").otherwise("tp")
    return joined.select(*keys, verdict.alias("verdict"), "rank", "found", "expected")
