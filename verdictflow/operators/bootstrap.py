"""Bootstrap confidence intervals: resamples as weights of cases, one product with the counters, order statistics.

A resample of n cases is a vector of n multiplicities. Counters are packed into blocks of cases, one row each, and a
group of turns meets all blocks in one task: there the multiplicities of its turns, drawn once, are multiplied with
each block and summed, so a turn leaves its task as one row of sums. There is never a row for a draw.

Two generators draw. lcg() is an integer formula that any SQL engine can repeat. seeded() draws what Python's
random.Random(seed).choice draws case after case; the driver runs through the generator once and keeps its state at
the start of each group of turns (2.5 kB), from which tasks go on, and go on again when they are repeated.

The interval of B sorted values is [s[int(a * B)], s[min(int((1 - a) * B), B - 1)]], 0-based, a being half
of what the level leaves; neither percentile nor percentile_disc gives these positions.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import COUNTERS, metric_columns

#: Cases of a block of counters.
BLOCK = 1 << 14
#: Turns of a group at most, and multiplicities that a task holds, unless one turn has more.
GROUP_TURNS, GROUP_WEIGHTS = 25, 20_000_000
CHUNK = 1 << 20


@dataclass
class Draws:
    """turns resamples of n cases; of(g) gives those of group g, each as an array of case numbers."""

    n: int
    turns: int
    of: Callable[[int], Iterator[np.ndarray]]
    per_group: int

    @property
    def groups(self) -> int:
        return -(-self.turns // self.per_group)


def _per_group(n: int) -> int:
    return max(1, min(GROUP_TURNS, GROUP_WEIGHTS // max(n, 1)))


def lcg(n: int, turns: int) -> Draws:
    """Draws by (b * 7919 + pos * 104729 + 12345) * 48271 modulo 2147483647, modulo n."""
    per = _per_group(n)

    def of(g: int) -> Iterator[np.ndarray]:
        for b in range(g * per, min(turns, (g + 1) * per)):
            yield (b * 7919 + np.arange(n, dtype=np.int64) * 104729 + 12345) * 48271 % 2147483647 % n

    return Draws(n, turns, of, per)


def _generator(key: np.ndarray, pos: int) -> np.random.MT19937:
    out = np.random.MT19937()
    out.state = {"bit_generator": "MT19937", "state": {"key": key, "pos": pos}}
    return out


def _accepted(generator: np.random.MT19937, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunk by chunk, the numbers below n and their places among all that were generated; the rest is drawn anew, as choice() does."""
    shift, at = np.uint64(32 - n.bit_length()), 0
    while True:
        raw = generator.random_raw(CHUNK) >> shift
        place = np.flatnonzero(raw < n)
        yield raw[place].astype(np.int64), place + at
        at += CHUNK


def seeded(n: int, turns: int = 2000, seed: int = 42) -> Draws:
    """The draws of random.Random(seed).choice over n cases, turn after turn."""
    per = _per_group(n)
    if n >= 1 << 32:
        raise ValueError("a draw takes 32 bits")
    _, internal, _ = random.Random(seed).getstate()
    key, pos = np.array(internal[:-1], np.uint64), internal[-1]
    states = []
    for g in range(-(-turns // per) if n else 0):
        states.append((key, pos))
        left = n * min(per, turns - g * per)
        for values, place in _accepted(_generator(key, pos), n):
            if len(values) >= left:
                break
            left -= len(values)
        again = _generator(key, pos)
        for used in [CHUNK] * ((int(place[left - 1]) + 1) // CHUNK) + [(int(place[left - 1]) + 1) % CHUNK]:
            again.random_raw(used)
        key, pos = again.state["state"]["key"], again.state["state"]["pos"]

    def of(g: int) -> Iterator[np.ndarray]:
        held, chunks = np.empty(0, np.int64), _accepted(_generator(*states[g]), n)
        for _ in range(min(per, turns - g * per)):
            while len(held) < n:
                held = np.concatenate([held, next(chunks)[0]])
            yield held[:n]
            held = held[n:]

    return Draws(n, turns, of, per)


def numbered(rows: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """rows with case_idx from 0 in the order of the distinct number `key`: ranges between quantiles are numbered each by itself.

    Only the quantiles and one count for each range reach the driver; both follow from the rows alone, so a task that
    is run again numbers alike.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, shares)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    ranged = rows.withColumn("_part", part)
    start, starts = 0, []
    for r in sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts += [F.lit(r["_part"]), F.lit(start)]
        start += r["n"]
    first = F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("case_idx", (first + rank - 1).cast("long")).drop("_part")


def _packed(counters: list[str]):
    def run(cases: pa.Table) -> pa.Table:
        idx = cases.column("case_idx").to_numpy()
        matrix = np.stack([cases.column(c).to_numpy().astype(np.float64) for c in counters], 1)[np.argsort(idx)]
        return pa.table({"first": [int(idx.min())], "cells": pa.array([matrix.tobytes()], pa.binary())})

    return run


def _summed(draws: Draws, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, weights, sums = None, None, None

        def row() -> pa.RecordBatch:
            b = np.arange(len(sums), dtype=np.int64) + group * draws.per_group
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["b", "sums"])

        for batch in batches:
            for g, first, cells in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if g != group:
                    if group is not None:
                        yield row()
                    group, weights = g, np.stack([np.bincount(x, minlength=draws.n).astype(np.uint32) for x in draws.of(g)])
                    sums = np.zeros((len(weights), width))
                matrix = np.frombuffer(cells, np.float64).reshape(-1, width)
                sums += weights[:, first : first + len(matrix)].astype(np.float64) @ matrix
        if group is not None:
            yield row()

    return run


def resampled(counts: DataFrame, draws: Draws, counters: list[str] = COUNTERS) -> DataFrame:
    """b and the summed counters of each turn; counts has case_idx, from 0 to n - 1, and the counters.

    Sums are worked out in doubles, which are exact below 2^53.
    """
    own = counts.select("case_idx", *[F.col(c).cast("long").alias(c) for c in counters])
    blocks = own.groupBy(F.floor(F.col("case_idx") / BLOCK).alias("block")).applyInArrow(_packed(counters), "first long, cells binary")
    met = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(draws.groups - 1))).alias("g"), "first", "cells")
    sums = met.repartition(draws.groups, "g").sortWithinPartitions("g", "first").mapInArrow(_summed(draws, len(counters)), "b long, sums array<double>")
    return sums.select("b", *[F.get("sums", F.lit(i)).cast("long").alias(c) for i, c in enumerate(counters)])


def intervals(counts: DataFrame, draws: Draws, level: float = 0.95, extra: dict[str, Column] | None = None, counters: list[str] = COUNTERS) -> DataFrame:
    """metric, low, high of the fifteen metrics and of those the caller adds, as columns over the summed counters."""
    metrics = metric_columns(extra)
    long = resampled(counts, draws, counters).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])).alias("x")).select("x.*")
    a, turns = (1 - level) / 2, draws.turns
    low, high = int(a * turns) + 1, min(int((1 - a) * turns), turns - 1) + 1
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy("value")))
    return ranked.groupBy("metric").agg(F.max(F.when(F.col("r") == low, F.col("value"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("value"))).alias("high"))
