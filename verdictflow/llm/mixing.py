"""Mixing sources to target weights by balanced sampling with the cube method.

Sources by code point, null last, weigh 3, 1, 2, repeating; they share 150 % of all words, and a
target above twice its source's words is cut to that, the excess being reshared by weight. A
source's documents are each taken floor(f) times for certain, f being its target over its words, and
once more with probability f - floor(f). The cube method turns these probabilities into decisions:
in blocks of a source it moves three fractional probabilities at a time
along the null space of two constraints (documents and words), so both totals stay as they are,
until one is 0 or 1. A block leaves two fractional documents and the HELD that came last; those of all
blocks of a source fly again, in blocks, until one block holds them, and the last HELD + 2 land by the choice
nearest to the word target.

Defined results: null text has size 0; documents of size 0 are taken 0 words; a null source is a
source; null ids and repeated rows are documents of their own; extra columns are ignored; an empty
table gives an empty result. Random choices are seeded by source and block: reruns agree.
"""

from __future__ import annotations

import random
import zlib
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import attach_bounded, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 4096
HELD = 12
STEP = "doc_id long, uid long, source string, size long, base int, p double"


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row for each source: source, source_size, n, target. Sources are numbered without one large sort."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranged = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    start, starts = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, start))
        start += n
    spark = sizes.sparkSession
    first = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS)).cast("int") + 1)
    per = ranged.join(first, "part").withColumn("weight", weight).select("source", "source_size", "n", "weight")
    per = cut(per)
    most = F.col("source_size") * float(MOST)
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"] * SHARE
    level = 0.0
    while True:  # each turn caps at least one more source
        free = F.col("weight") * level < most if level else most > 0
        s = per.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(~free, most)), F.lit(0.0)).alias("capped")).first()
        new = (total - s["capped"]) / s["w"] if s["w"] else level
        if not s["w"] or new <= level * (1 + 1e-12):
            break
        level = new
    return per.select("source", "source_size", "n", F.least(F.col("weight") * level, most).alias("target"))


def _null_vector(a: tuple, b: tuple, c: tuple) -> tuple[float, float, float]:
    """v with v . (documents, words) = 0 for three units given as (documents, words) rows."""
    return b[0] * c[1] - c[0] * b[1], c[0] * a[1] - a[0] * c[1], a[0] * b[1] - b[0] * a[1]


class Flight:
    """Streams units (key, size, p) of one block: at most three fly, and the last HELD wait."""

    def __init__(self, seed: int):
        self.random, self.open, self.wait = random.Random(seed), [], deque()

    def add(self, key, size: int, p: float) -> Iterator[tuple]:
        """Yields units that have been decided, as (key, 0 or 1)."""
        if p <= 1e-12 or p >= 1 - 1e-12:
            yield key, round(p)
            return
        self.wait.append([key, size, p])
        if len(self.wait) <= HELD:
            return
        self.open.append(self.wait.popleft())
        while len(self.open) == 3:
            v = _null_vector(*[(1.0, float(u[1])) for u in self.open])
            if not any(v):
                v = (1.0, -1.0, 0.0)  # equal sizes
            up = min((1 - u[2]) / x if x > 0 else u[2] / -x for u, x in zip(self.open, v) if x)
            down = min(u[2] / x if x > 0 else (1 - u[2]) / -x for u, x in zip(self.open, v) if x)
            move = up if self.random.random() * (up + down) < down else -down
            for u, x in zip(self.open, v):
                u[2] += move * x
            left = []
            for u in self.open:
                if u[2] <= 1e-9 or u[2] >= 1 - 1e-9:
                    yield u[0], round(u[2])
                else:
                    left.append(u)
            if len(left) == 3:  # rounding kept it open: the unit nearest to 0 or 1 is done
                left.sort(key=lambda u: min(u[2], 1 - u[2]))
                done = left.pop(0)
                yield done[0], round(done[2])
            self.open = left

    def left(self) -> list[list]:
        return [*self.open, *self.wait]

    def land(self) -> Iterator[tuple]:
        """Settles what is left by the choice whose words, then documents, come nearest to those expected."""
        units = self.left()
        size, p = np.array([u[1] for u in units], float), np.array([u[2] for u in units])
        choice = np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1
        off = np.round(np.abs(choice @ size - size @ p), 6)
        best = choice[np.lexsort((np.abs(choice.sum(axis=1) - p.sum()), off))[0]]
        yield from ((u[0], int(x)) for u, x in zip(units, best))


def _fly(last: bool):
    """Flight over rows sorted by source and block; fractional units stay so unless this is the last turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, flight = None, None

        def close():
            if flight is None:
                return []
            return list(flight.land()) if last else [(u[0], u[2]) for u in flight.left()]

        for b in batches:
            done: list[tuple] = []
            ids = [None if pd.isna(x) else int(x) for x in b["doc_id"]]
            for row in zip(ids, b["uid"], b["source"], b["size"], b["base"], b["p"], b["block"]):
                g = (row[2], row[6])
                if flight is None or g != group:
                    done += close()
                    name = "-" if row[2] is None else "+" + row[2]
                    group, flight = g, Flight(zlib.crc32(f"{name}/{row[6]}/{last}".encode()))
                done += flight.add(row[:5], int(row[3]), float(row[5]))
            yield _decided(done)
        yield _decided(close())

    return run


def _decided(done: list[tuple]) -> pd.DataFrame:
    k = [x[0] for x in done]
    return pd.DataFrame({"doc_id": pd.array([x[0] for x in k], dtype="Int64"), "uid": [x[1] for x in k], "source": pd.Series([x[2] for x in k], dtype=object), "size": [x[3] for x in k], "base": [x[4] for x in k], "p": [float(x[1]) for x in done]})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, copies, taken."""
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("uid")))
    # A null source joins as a key of its own.
    keyed = sizes.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    targets = cut(source_targets(sizes).withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).drop("source"))
    factor = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0))
    base = F.when(F.col("factor") >= MOST, F.lit(MOST)).otherwise(F.floor("factor")).cast("int")
    units = attach_bounded(keyed, targets, ["key"]).withColumn("factor", factor).withColumn("base", base)
    units = units.withColumn("p", F.col("factor") - F.col("base")).withColumn("block", F.pmod(F.xxhash64("doc_id", "uid"), F.ceil(F.col("n") / BLOCK)).cast("int"))
    order = ["source", "block", "uid", "doc_id", "size"]
    step = units.select("doc_id", "uid", "source", "size", "base", "p", "block").repartition("source", "block").sortWithinPartitions(*order)
    flown = cut(step.mapInPandas(_fly(False), STEP))
    whole = (F.col("p") == 0) | (F.col("p") == 1)
    parts, turn = [flown.where(whole)], 0
    # A block leaves at most HELD + 2 of its documents open, so the turns grow with the logarithm of a source's size.
    while (most := flown.where(~whole).groupBy("source").count().agg(F.max("count")).first()[0] or 0) > BLOCK:
        turn += 1
        again = F.pmod(F.xxhash64("doc_id", "uid", F.lit(turn)), F.lit(-(-most // BLOCK))).cast("int")
        flown = cut(flown.where(~whole).withColumn("block", again).repartition("source", "block").sortWithinPartitions(*order).mapInPandas(_fly(False), STEP))
        parts.append(flown.where(whole))
    rest = flown.where(~whole).withColumn("block", F.lit(0)).repartition("source").sortWithinPartitions(*order)
    parts.append(cut(rest.mapInPandas(_fly(True), STEP)))
    decided = reduce(DataFrame.unionByName, parts).withColumn("copies", F.col("base") + F.col("p").cast("int"))
    decided = decided.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    out = attach_bounded(decided, targets, ["key"])
    return out.select("doc_id", "uid", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of docs.

    Rows that repeat id, text and source share their number of copies; each stands for its own share of it, and one task
    deals it out to them in the order of a hash of the whole row, so that reruns agree where their other columns differ.
    """
    key = ["_id", "_uid", "_src"]
    text_id = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    from_source = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    chosen = mix(docs, id_col, text_col, source_col).groupBy(text_id("doc_id").alias("_id"), F.col("uid").alias("_uid"), from_source("source").alias("_src")).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_n"))
    same = Window.partitionBy(*key).orderBy(F.when(F.col("_n") > 1, F.xxhash64(F.to_json("_row"))))
    rows = docs.select(F.struct("*").alias("_row"), text_id(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_uid"), from_source(source_col).alias("_src"))
    joined = rows.join(chosen.where("_sum > 0"), key).withColumn("_k", F.row_number().over(same))
    copies = F.floor(F.col("_sum") / F.col("_n")) + F.when(F.col("_k") <= F.col("_sum") % F.col("_n"), 1).otherwise(0)
    return joined.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
