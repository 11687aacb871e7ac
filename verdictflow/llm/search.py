"""Ranked lexical search over an inverted index: document at a time, by a k-way heap merge of postings.

Index. Each task cuts the documents it reads into segments (the shards of the index) of at most about SEGMENT_TERMS
terms and writes them without any shuffle: one row for each term with its postings, sorted by doc_id and compressed
(the gaps between documents and the occurrences as variable-length bytes), and one row with the segment's documents.
A term that every document holds is thus spread over all segments.

Search. Only the postings of the queries' terms are shuffled, to one group for each segment and block of queries.
There the lists of a query are merged by a heap of their next documents, so that each document's score is complete
before the next one's begins; a heap of the k best is all that is kept. Lists whose largest gains together cannot
lift a document above the worst of the k best leave the merge; a document found in the others looks its place up
in them as long as that can still matter. So nothing that could be returned is passed over. The groups' best are then
merged for each query.

Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. The score is
integer arithmetic; see gains().

Defined results: a text that is null or has no term is no document of the collection; copies and rows that repeat an
id are documents of their own; equal scores are ordered by ascending doc_id, null last; queries of one id are one query
with the terms of all of them, a query without terms finds nothing; extra columns are ignored; an empty table of
documents or queries gives an empty result.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import attach_bounded, cut, delete_path, frugal, scratch_path, small_batches

#: Terms of a segment, about, with repeats; a longer document is a segment by itself.
SEGMENT_TERMS = 2_000_000
#: Queries that are searched together in a group, about.
BLOCK_QUERIES = 256
TOP = 10
#: Of the score: b of 0.9 as hundredths, and how gains are scaled.
LENGTH_SHARE, SCALE = 90, 1_000_000_000
#: What is no part of a term, as a pattern and as a table of bytes that also lower-cases A-Z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
PIECE = 4 << 20
INDEX = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("postings", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
FOUND = "item_id long, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """The terms of a text in UTF-8 and their occurrences, counted piece by piece."""
    plain, counts, start = text.translate(BYTES), Counter(), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        counts.update(plain[start:end].split())
        start = end
    return counts


def query_terms(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(TERM), F.lit(0)))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes, low seven bits first; and where each value's bytes end."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        size += v >= (1 << bits)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for i in range(int(size.max()) if len(v) else 0):
        own = size > i
        more = (size[own] > i + 1).astype(np.uint8) << 7
        out[(ends - size)[own] + i] = ((v[own] >> np.uint64(7 * i)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


class _Segment:
    """Documents that are being gathered; rows() gives them as rows of the index."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.times, self.each = array("i"), array("i"), array("i")
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.total = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        counts = term_counts(text)
        if not counts:
            return
        known = self.vocabulary
        self.terms.extend([known.setdefault(t, len(known)) for t in counts])
        self.times.extend(counts.values())
        self.each.append(len(counts))
        self.ids.append(doc_id)
        self.lengths.append(counts.total())
        self.total += self.lengths[-1]

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        docs = np.repeat(place, np.frombuffer(self.each, np.int32))
        terms, times = np.frombuffer(self.terms, np.int32), np.frombuffer(self.times, np.int32)
        by = np.lexsort((docs, terms))
        docs, terms, times = docs[by], terms[by], times[by]
        firsts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        gaps = np.diff(docs, prepend=0)
        gaps[firsts] = docs[firsts]
        data, ends = pack(np.stack([gaps, times], 1).ravel())
        cuts = np.concatenate([[0], ends[2 * np.append(firsts[1:], len(terms)) - 1]])
        raw, df = data.tobytes(), np.diff(np.append(firsts, len(terms)))
        names = [t.decode() for t in self.vocabulary]
        yield pa.RecordBatch.from_pylist([{"segment": number, "df": n, "ids": [self.ids[i] for i in order], "lengths": [self.lengths[i] for i in order]}], schema=INDEX)
        for s in range(0, len(names), 10_000):
            part = range(s, min(len(names), s + 10_000))
            columns = [pa.array([number] * len(part), pa.int64()), pa.array(names[s : s + 10_000], pa.string()), pa.array(df[s : s + 10_000], pa.int64()), pa.array([raw[cuts[i] : cuts[i + 1]] for i in part], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(part), f.type) for f in list(INDEX)[4:]]], schema=INDEX)


def _index(segment_terms: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, number = _Segment(), TaskContext.get().partitionId() << 24
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                segment.add(doc_id, text)
                if segment.total >= segment_terms:
                    yield from segment.rows(number)
                    segment, number = _Segment(), number + 1
        if segment.ids:
            yield from segment.rows(number)

    return run


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", segment_terms: int = SEGMENT_TERMS) -> None:
    """Write the index of docs to the folder `path`, as Parquet: segment, term, df, postings; ids and lengths where term is null."""
    rows = docs.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8").alias("text")).where(F.col("text").isNotNull())
    fields = ", ".join(f"{f.name} {'array<bigint>' if pa.types.is_list(f.type) else {'int64': 'bigint'}.get(str(f.type), str(f.type))}" for f in INDEX)
    with small_batches(docs.sparkSession):
        rows.mapInArrow(_index(segment_terms), fields).write.parquet(path)


def gains(times: np.ndarray, lengths: np.ndarray, weight: int, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term adds to the score of documents in which it occurs `times`, of `lengths` terms each."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * n_docs) // n_terms
    return weight * ((SCALE * times) // (1000 * times + 8 * m))


def best_documents(lists: list[tuple[array, array, int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of postings lists: documents ascending, their gains, the largest gain."""
    lists = sorted(lists, key=lambda x: x[2])
    docs, gain, n = [x[0] for x in lists], [x[1] for x in lists], len(lists)
    bounds = np.cumsum([x[2] for x in lists]).tolist()  # what the lists up to this one add at most
    at, best, floor, first = [0] * n, [], 0, 0
    while first < n and bounds[first] <= floor:
        first += 1
    heap = [d[0] * n + j for j, d in enumerate(docs) if j >= first]
    heapify(heap)
    while heap:
        doc, score = heap[0] // n, 0
        end = (doc + 1) * n
        while heap and heap[0] < end:
            j = heap[0] % n
            p = at[j]
            score += gain[j][p]
            p = at[j] = p + 1
            if p < len(docs[j]):
                heapreplace(heap, docs[j][p] * n + j)
            else:
                heappop(heap)
        for j in range(first - 1, -1, -1):
            if score + bounds[j] <= floor:
                break
            own = docs[j]
            p = at[j] = bisect_left(own, doc, at[j])
            if p < len(own) and own[p] == doc:
                score += gain[j][p]
        if score > floor:  # of equal scores the earlier document stays
            if len(best) < k:
                heappush(best, (score, -doc))
            else:
                heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > floor:
                floor = best[0][0]
                before = first
                while first < n and bounds[first] <= floor:
                    first += 1
                if first > before:
                    heap = [x for x in heap if x % n >= first]
                    heapify(heap)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _search(k: int, n_docs: int, n_terms: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        shard = next(r for r in rows if r["ids"] is not None)
        lengths, queries = np.array(shard["lengths"], np.int64), {}
        for r in rows:
            if r["postings"] is None:
                continue
            flat = unpack(r["postings"]).reshape(-1, 2)
            docs = np.cumsum(flat[:, 0])
            gain = gains(flat[:, 1], lengths[docs], r["weight"], n_docs, n_terms)
            own = array("i", docs.astype(np.int32).tobytes()), array("q", gain.tobytes()), int(gain.max())
            for q in r["queries"]:
                queries.setdefault(q["item_id"], []).append(own)
        found = [(q, shard["ids"][d], s) for q, lists in queries.items() for s, d in best_documents(lists, k)]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return run


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP, item_id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The k best documents of the index for each query: item_id, rank, doc_id, score."""
    index = spark.read.parquet(path)
    shards, postings = index.where(F.col("term").isNull()), index.where(F.col("term").isNotNull())
    size = shards.agg(F.sum("df").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    if not size["n"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    items = queries.select(F.col(item_id_col).cast("long").alias("item_id"), F.explode(query_terms(F.col(text_col))).alias("term")).distinct()
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0))), F.lit(blocks)).cast("int")
    wanted = items.groupBy("term", block.alias("block")).agg(F.collect_list(F.struct("item_id")).alias("queries"))
    wanted = cut(wanted.groupBy("term").agg(F.collect_list(F.struct("block", "queries")).alias("asked")))
    hits = attach_bounded(postings.select("segment", "term", "df", "postings"), wanted.select("term"), ["term"], None, "inner")
    df = hits.groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * size["n"] + 2) / (2.0 * F.col("n") + 1)))
    wanted = cut(df.join(wanted, "term").select("term", "asked", weight.alias("weight")))
    own = attach_bounded(postings.select("segment", "term", "postings"), wanted, ["term"], None, "inner")
    own = own.select("segment", "weight", "postings", F.explode("asked").alias("asked")).select("asked.block", "segment", "weight", "asked.queries", "postings", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("lengths"))
    none = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("weight", "queries", "postings")]
    read = shards.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "segment", *none, "ids", "lengths")
    found = own.unionByName(read).groupBy("block", "segment").applyInArrow(_search(k, size["n"], size["l"]), FOUND)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = TOP, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """The k best of docs for each query; the index is written to the shared folder and deleted once it is searched."""
    path = scratch_path(docs.sparkSession, "index")
    write_index(docs, path, segment_terms=segment_terms)
    out = cut(search(docs.sparkSession, path, queries, k))
    delete_path(docs.sparkSession, path)
    return out
