"""Exact deduplication with a cuckoo-filter index over content digests.

A text's digest is SHA-256 of its white-space-normalised form. Each task keeps a cuckoo filter of
the live digests; a filter hit is verified against the stored keys of the bucket it points to, and
an overflowing filter is rebuilt at twice the size from those keys. Digests are combined before the
shuffle, so a group of copies reaches its task as one row for each map task, and they arrive sorted,
so a closed digest is deleted from the index and memory stays within one Arrow batch.

Defined results: null text counts as empty; null ids sort last (a group of null ids has keep_id
null); of rows that repeat both id and text only one is kept; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import attach, cut

SLOTS = 4
MAX_KICKS = 200
LOCAL_LIMIT = 100_000
PARTIAL = "digest binary, keep_id long, keep_row long, n long"


class CuckooIndex:
    """Live digests: a cuckoo filter of 16-bit tags in front of bucketed keys with [smallest id, its row, count]."""

    def __init__(self, bits: int = 8):
        self._reset(bits)
        self.resizes = 0

    def _reset(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.tags = array("H", bytes(2 * SLOTS << bits))
        self.content: dict[int, dict[bytes, list]] = {}
        self.size = 0

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:8], "big") & self.mask
        return tag, first, (first ^ (tag * 0x5BD1E995)) & self.mask

    def _maybe(self, tag: int, first: int, second: int) -> bool:
        t = self.tags
        return tag in t[first * SLOTS : first * SLOTS + SLOTS] or tag in t[second * SLOTS : second * SLOTS + SLOTS]

    def get(self, digest: bytes) -> list | None:
        tag, first, second = self._place(digest)
        return self.content.get(first, {}).get(digest) if self._maybe(tag, first, second) else None

    def _put_tag(self, tag: int, first: int, second: int) -> bool:
        t, at = self.tags, first
        for b in (first, second):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        for kick in range(MAX_KICKS):
            s = at * SLOTS + kick % SLOTS
            t[s], tag = tag, t[s]
            at = (at ^ (tag * 0x5BD1E995)) & self.mask
            for s in range(at * SLOTS, at * SLOTS + SLOTS):
                if not t[s]:
                    t[s] = tag
                    return True
        return False

    def _grow(self) -> None:
        """Rebuild at twice the size, or more, from the stored keys."""
        stored, bits = list(self.items()), self.bits
        while True:
            bits += 1
            self.resizes += 1
            self._reset(bits)
            if all(self._insert(d, v) for d, v in stored):
                return

    def _insert(self, digest: bytes, value: list) -> bool:
        tag, first, second = self._place(digest)
        if not self._put_tag(tag, first, second):
            return False
        self.content.setdefault(first, {})[digest] = value
        self.size += 1
        return True

    def add(self, digest: bytes, doc_id: int | None, n: int = 1, row: int = 0) -> bool:
        """Count a copy; True if the digest was not live before."""
        live = self.get(digest)
        if live is not None:
            live[2] += n
            if (doc_id is None, doc_id or 0, row) < (live[0] is None, live[0] or 0, live[1]):
                live[:2] = doc_id, row
            return False
        value = [doc_id, row, n]
        if self.size * 10 >= 9 * SLOTS << self.bits:
            self._grow()
        if not self._insert(digest, value):
            # A failed chain has lost one tag: the rebuild restores all of them from the keys.
            self.content.setdefault(self._place(digest)[1], {})[digest] = value
            self._grow()
        return True

    def delete(self, digest: bytes) -> list | None:
        live = self.get(digest)
        if live is None:
            return None
        tag, first, second = self._place(digest)
        for b in (first, second):
            for s in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.tags[s] == tag:
                    self.tags[s] = 0
                    self.size -= 1
                    del self.content[first][digest]
                    return live
        raise AssertionError("a live digest has a tag")

    def items(self) -> Iterator[tuple[bytes, list]]:
        for held in self.content.values():
            yield from held.items()


def _frame(found: Iterable[tuple[bytes, list]]) -> pd.DataFrame:
    rows = [(d, *v) for d, v in found]
    return pd.DataFrame({"digest": [r[0] for r in rows], "keep_id": pd.array([r[1] for r in rows], dtype="Int64"), "keep_row": [r[2] for r in rows], "n": [r[3] for r in rows]})


def _ids(col: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in col]


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: one row for each digest and task, or for each LOCAL_LIMIT live digests."""
    index = CuckooIndex()
    for b in batches:
        for d, i, row in zip(b["digest"], _ids(b["doc_id"]), b["row"]):
            index.add(bytes(d), i, 1, int(row))
        if index.size > LOCAL_LIMIT:
            yield _frame(index.items())
            index = CuckooIndex()
    yield _frame(index.items())


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """After it, sorted by digest: what no later row can touch is emitted and deleted."""
    index = CuckooIndex()
    for b in batches:
        last = None
        for d, i, row, n in zip(b["digest"], _ids(b["keep_id"]), b["keep_row"], b["n"]):
            last = bytes(d)
            index.add(last, i, int(n), int(row))
        done = [d for d, _ in index.items() if d != last]
        yield _frame([(d, index.delete(d)) for d in done])
    yield _frame(index.items())


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; only runs that change are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?:[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+)", " ")


def exact_groups(digests: DataFrame) -> DataFrame:
    """(doc_id, row, digest binary) to one row for each digest: digest, keep_id, keep_row, group_size."""
    partial = digests.select("doc_id", "row", "digest").mapInPandas(_combine, PARTIAL)
    dealt = partial.repartition("digest").sortWithinPartitions("digest")
    return dealt.mapInPandas(_resolve, PARTIAL).withColumnRenamed("n", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest")))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # the place in files that do not change
    groups = cut(exact_groups(rows)).where("group_size > 1")
    out = attach(rows, groups, ["digest"])
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
