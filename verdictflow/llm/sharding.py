"""Sharding by sampled splitters, under the law that the shards' bytes are near equal.

A document's key is the hash of its text, so equal texts stay together. Size-weighted samples of keys
give quantile boundaries; rows are range-partitioned by them, ranges whose exact size is too large
are subdivided by further samples, and a key too heavy for any range gets a range of its own. The
ranges then go to shards, largest first, each to the shard with the least bytes.

Defined results: null text has no bytes and counts as an equal of the empty text; null ids are kept;
repeated rows each get a slot; columns of the input that clash with a result column are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut

RANGES_PER_SHARD = 256
ROWS_PER_RANGE = 1_000_000
DRAWS_PER_RANGE = 32


@dataclass
class ShardPlan:
    """Splitters of the key space, and for each range: its shard and the parts in which it is numbered.

    A part has about twice a range's mean rows at most, so the rows of a hot key are numbered by many tasks.
    """

    splitters: np.ndarray
    shard: dict[int, int] = field(default_factory=dict)
    parts: dict[int, int] = field(default_factory=dict)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return find


def _drawn(rows: DataFrame, per_byte: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys drawn in proportion to size, and the bytes that each stands for."""
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    # Equal rows are drawn alike; they are one row, with their bytes, before they leave their task.
    drawn = rows.where(u < F.col("size") * per_byte).groupBy("key", "doc_id").agg(F.sum(F.greatest("size", F.lit(1 / per_byte))).alias("weight"))
    pdf = drawn.select("key", "weight").toPandas().sort_values(["key", "weight"])
    return pdf["key"].to_numpy(dtype=np.int64), pdf["weight"].to_numpy(dtype=float)


def quantile_splitters(keys: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n-1 boundaries of near equal weight; a key of more than one quantile is fenced on both sides."""
    if not len(keys):
        return np.empty(0, np.int64)
    cum = np.cumsum(weights)
    at = keys[np.minimum(np.searchsorted(cum, cum[-1] * np.arange(1, n) / n), len(keys) - 1)]
    values, counts = np.unique(at, return_counts=True)
    heavy = values[(counts > 1) & (values < np.iinfo(np.int64).max)]
    return np.unique(np.concatenate([values, heavy + 1]))


def subdivided(low: int, high: int, pieces: int, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Splitters inside low < high by the draws between them; the middle where these give none, so that a range always shrinks."""
    own = (keys >= low) & (keys <= high)
    found = quantile_splitters(keys[own], weights[own], pieces)
    found = found[(found > low) & (found <= high)]
    return found if len(found) else np.array([low + (high - low + 1) // 2], np.int64)


def plan_shards(rows: DataFrame, shards: int) -> ShardPlan:
    """rows: (doc_id, key, size). Only samples and one row for each range reach the driver.

    Ranges are subdivided until none of several keys is too large; a round halves a range at least.
    """
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    if not total["n"]:
        return ShardPlan(np.empty(0, np.int64))
    n = max(shards * RANGES_PER_SHARD, -(-total["n"] // ROWS_PER_RANGE))
    splitters = quantile_splitters(*_drawn(rows, n * DRAWS_PER_RANGE / total["bytes"], 1), n)
    turn = 0
    while True:
        ranged = rows.withColumn("range", _range_of(splitters)("key"))
        stats = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        over = [s for s in stats if s["bytes"] > 2 * total["bytes"] / n and s["low"] < s["high"]]
        if not over:
            break
        per_byte = n * DRAWS_PER_RANGE * 8 / total["bytes"]
        keys, weights = _drawn(ranged.where(F.col("range").isin([s["range"] for s in over])), per_byte, 2 + turn)
        for s in over:
            splitters = np.union1d(splitters, subdivided(s["low"], s["high"], max(2, int(np.ceil(2 * s["bytes"] * n / total["bytes"]))), keys, weights))
        turn += 1
    plan, heap = ShardPlan(splitters), [(0, i) for i in range(shards)]
    for s in sorted(stats, key=lambda s: (-s["bytes"], s["range"])):
        load, shard = heapq.heappop(heap)
        plan.shard[s["range"]] = shard
        plan.parts[s["range"]] = -(-s["n"] * len(stats) // (2 * total["n"]))
        heapq.heappush(heap, (load + s["bytes"], shard))
    return plan


def apply_plan(rows: DataFrame, counted: DataFrame, plan: ShardPlan) -> DataFrame:
    """Add shard and slot to rows; `counted` are their slim forms, of which the parts are counted; `spread` deals both alike."""
    spark = rows.sparkSession
    if not plan.shard:
        return rows.drop("spread").withColumns({"shard": F.lit(None).cast("int"), "slot": F.lit(None).cast("long")})
    parts = F.broadcast(spark.createDataFrame([(r, plan.parts[r]) for r in sorted(plan.shard)], "range int, parts int"))

    def dealt(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64("spread"), F.col("parts").cast("long")).cast("int")
        return df.withColumn("range", _range_of(plan.splitters)("key")).join(parts, "range").withColumn("part", part)

    counts = sorted((r["range"], r["part"], r["n"]) for r in dealt(counted).groupBy("range", "part").agg(F.count("*").alias("n")).collect())
    used: dict[int, int] = {}
    starts = []
    for r, p, n in counts:
        shard = plan.shard[r]
        starts.append((r, p, shard, used.get(shard, 0)))
        used[shard] = used.get(shard, 0) + n
    starts = F.broadcast(spark.createDataFrame(starts, "range int, part int, shard int, start long"))
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id")
    out = dealt(rows).withColumn("_rank", F.row_number().over(order)).join(starts, ["range", "part"])
    return out.withColumn("slot", F.col("start") + F.col("_rank") - 1).drop("range", "parts", "part", "_rank", "start", "spread")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("key"), text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"))


def shard_table(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shard and slot of each row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = cut(_slim(docs, id_col, text_col)).withColumn("spread", F.monotonically_increasing_id())
    out = apply_plan(rows, rows, plan_shards(rows, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows themselves, with size, text_crc32, law, shard and slot; they are shuffled once, by range.

    Rows of equal id and text are numbered by one task: nothing tells them apart in two reads of docs.
    """
    spread = F.xxhash64("doc_id", "key")
    rows = cut(_slim(docs, id_col, text_col)).withColumn("spread", spread)
    own = [c for c in docs.columns if c not in ("size", "text_crc32", "law", "shard", "slot")]
    packed = docs.select(F.struct(*own).alias("row"), F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), text_size(F.col(text_col)).alias("size"), F.crc32(F.coalesce(text_col, F.lit(""))).alias("text_crc32"))
    packed = packed.withColumn("spread", spread)
    return apply_plan(packed, rows, plan_shards(rows, shards)).select("row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")
