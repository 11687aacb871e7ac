"""Connected components over a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import attach, cut, release, uncut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or, in a small star, all smaller) neighbours to its smallest one.

    Edges have a > b. Each is read in one branch of the plan, so that turns stay cheap to plan.
    """
    ends = edges
    if large:
        ends = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    low = ends.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("low"))
    joined = attach(ends, low, ["a"], ["b"], "inner")
    if large:
        joined = joined.where("b > a")
    # In a small star the smallest neighbour's own row, which would be a loop, carries the node itself.
    end = F.col("b") if large else F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
    return joined.select(end.alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges with a > b are stars: no node leads to two others, or to one that leads on."""
    side = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    ends = edges.select(F.inline(F.array(side("a", 1), side("b", 0)))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame, most_turns: int = 60) -> DataFrame:
    """(a, b) edges of longs to (node, component), component being the smallest node reachable.

    Each turn is cut at the shared checkpoint folder; turns grow with the logarithm of the longest
    path. Hot nodes are spread by salted joins, and their minima are combined before the shuffle. The
    driver's garbage is collected after each turn: it keeps account of every stage, task and plan.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_turns):
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = cut(_star(edges, True))
        before, edges = edges, cut(_star(large, False))
        uncut(before, large)
        release(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {most_turns} turns")
