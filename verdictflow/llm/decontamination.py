"""Benchmark decontamination by size-partitioned MinHash containment search (DataFrame functions only).

Test items are short and documents long, so containment is what counts: the share of an item's
distinct five-word shingles that a document holds, 0.8 or more. Items are partitioned by the size of
their shingle set, in powers of two; an item's sketch is its bottom-k MinHash, k being so large for
its partition that a document with the wanted containment must hold one of the k shingles. So no
document is missed. A document's shingles probe the sketches; each candidate pair is verified by
exact containment of the shingles themselves. An item of fewer words is one shingle of all of them.

Words are lower-cased runs of letters and digits. Defined results: null or wordless texts match nothing;
documents match by text, so copies all match; null ids are kept; an item id that repeats matches if
any of its texts does (its largest containment is returned); extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import attach, attach_bounded, cut

WORDS = 5
CONTAINMENT = 0.8
#: Sketch and shingle tables of more rows are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _shingles(w: Column, k: int, make) -> Column:
    """make(words) for every k consecutive words; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(at, lambda i: make(*[F.get(w, i + j) for j in range(k)])))


def _hashed(w: Column, k: int) -> Column:
    return _shingles(w, k, F.xxhash64)


def _plain(w: Column, k: int) -> Column:
    return _shingles(w, k, lambda *x: F.concat_ws(" ", *x))


def _sized(df: DataFrame, sizes: list[int], make) -> DataFrame:
    """One row for each shingle of each wanted length k, from the column w."""
    per = [F.struct(F.lit(k).alias("k"), make(F.col("w"), k).alias("s")) for k in sizes]
    out = df.withColumn("x", F.explode(F.array(*per))) if len(per) > 1 else df.withColumn("x", per[0])
    return out.select("*", F.col("x.k").alias("k"), F.explode("x.s").alias("s")).drop("x", "w")


def item_sketches(items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(item, k, n, s): the bottom-k hashes of each item; items: (item, w) with at least one word."""
    own = items.withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    hashed = F.coalesce(*[F.when(F.col("k") == k, F.array_sort(F.array_distinct(_hashed(F.col("w"), k)))) for k in range(1, WORDS + 1)])
    sized = own.withColumn("all", hashed).withColumn("n", F.size("all"))
    most = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") + 1))) - 1  # the largest set of the item's partition
    take = F.least(F.col("n"), (most - F.ceil(most * share - 1e-9) + 1).cast("int"))
    return sized.select("item", "k", "n", F.explode(F.slice("all", F.lit(1), take)).alias("s"))


def contained_items(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """(t, b, item_id, shared, n): texts, by hash and length, that hold an item."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = items.groupBy("w").agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("null_id")).withColumn("item", F.xxhash64("w"))
    items = cut(items)
    sizes = sorted(r["k"] for r in items.select(F.least(F.size("w"), F.lit(WORDS)).alias("k")).distinct().collect()) or [WORDS]
    keyed = docs.select(F.xxhash64(text_col).alias("t"), F.octet_length(text_col).alias("b"), F.col(text_col).alias("text"))
    texts = keyed.select("t", "b", words(F.col("text")).alias("w"))
    sketches = cut(item_sketches(items.select("item", "w"), share).withColumnRenamed("s", "h"))
    probes = _sized(texts.withColumn("most", F.size("w")), sizes, _hashed).withColumnRenamed("s", "h")
    pairs = attach_bounded(probes, sketches, ["k", "h"], ["t"], "inner", BROADCAST_ROWS).where(F.col("most") - F.col("k") + 1 >= F.col("n") * share - 1e-9)
    pairs = cut(pairs.select("t", "b", "item", "n", "k").distinct())
    candidates = pairs.select("t", "b").distinct()
    # Only candidates' texts are taken apart again.
    near = attach_bounded(keyed, candidates, ["t", "b"], None, "left_semi", BROADCAST_ROWS).dropDuplicates(["t", "b"])
    held = _sized(near.select("t", "b", words(F.col("text")).alias("w")), sizes, _plain).distinct()
    wanted = items.withColumn("kk", F.least(F.size("w"), F.lit(WORDS))).select("item", F.explode(F.coalesce(*[F.when(F.col("kk") == k, F.array_distinct(_plain(F.col("w"), k))) for k in range(1, WORDS + 1)])).alias("s"), F.col("kk").alias("k"))
    both = attach_bounded(held, wanted, ["k", "s"], ["t"], "inner", BROADCAST_ROWS).groupBy("t", "b", "item").agg(F.count("*").alias("shared"))
    exact = both.join(pairs, ["t", "b", "item"]).where(F.col("shared") >= F.col("n") * share - 1e-9)
    named = items.select("item", F.explode(F.when(F.col("null_id"), F.concat("ids", F.array(F.lit(None)))).otherwise(F.col("ids"))).alias("item_id"))
    exact = attach_bounded(exact, named, ["item"], ["t"], "inner", BROADCAST_ROWS)
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("containment"), F.col("shared"), F.col("n"))).alias("x")
    return exact.groupBy("t", "b", "item_id").agg(best).select("t", "b", "item_id", "x.shared", "x.n")


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, shared, item_shingles, containment."""
    found = cut(contained_items(docs, benchmark, share, text_col, item_id_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("t"), F.octet_length(text_col).alias("b"))
    out = attach(rows, found, ["t", "b"], None, "inner")
    return out.select("doc_id", "item_id", F.col("shared").cast("long").alias("shared"), F.col("n").cast("long").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = CONTAINMENT, text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    found = cut(contained_items(docs, benchmark, share, text_col, item_id_col).select("t", "b").distinct())
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("t"), F.octet_length(text_col).alias("b"))
    keyed = rows.withColumn("b", F.coalesce("b", F.lit(-1)))
    return attach_bounded(keyed, found, ["t", "b"], None, "left_anti", BROADCAST_ROWS).select("row.*")
