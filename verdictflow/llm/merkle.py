"""A Merkle manifest of a data set: one leaf for each row, a tree for each group, and one tree over the groups' roots.

Leaves of a group are ordered by id and cut into blocks of 2^LEVELS. A block is one row with an array of its
leaves, which higher-order functions collapse level by level: `sequence` walks a level, `slice` takes a run of
two, `transform` hashes the runs and `aggregate` repeats this for all levels of the block. The roots of blocks
are the nodes of the next round, which has 1/1024 of the rows, until each group has one root; the groups' roots
are then the leaves of a last tree. Only DataFrame functions are used.

Rows are numbered within their group by one range shuffle: a row's place in its sorted partition and the counts
of the partitions before it tell its number, so a hot group is numbered by many tasks.

Defined results: a null field hashes as `-`, which no value does; null ids come first in their group, rows of one
id are ordered by their leaf (rows that are equal throughout have equal leaves, and each its own place); a null
group is a group of its own and comes first; empty texts are values of no bytes; extra columns are ignored; an
empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, uncut

#: Levels that a block collapses; a block has at most 2^LEVELS nodes.
LEVELS = 10
#: The fields of a leaf, in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Tables of more rows are joined by shuffle.
BROADCAST_ROWS = 5_000


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts put together, in lower-case hexadecimal digits."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*fields: Column) -> Column:
    """The hash of a row: of each field `-` if it is null, else its count of UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _group_key(group: Column) -> Column:
    """The group as a string that is never null and sorts null first, else by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def _attach(rows: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Join by a key that both sides have once (or `rows` once for each of few rows of `other`)."""
    small = other.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(other) if small else other.hint("merge"), key)


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add pos, a row's number within its group `g` from 0, and total, the rows of the group.

    `rows` should be cut: they are read once for the boundaries of the ranges and once to be dealt out. Rows that are
    equal in `order` are told apart by their place, so they too are spread over the ranges.
    """
    keys = ["g", *order, "_place"]
    ranged = cut(rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place"))
    placed = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("g", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("g")).alias("total"))
    out = cut(_attach(placed, runs, ["g", "_part"]).withColumn("pos", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_start"))
    uncut(ranged)
    return out


def _parents(level: Column) -> Column:
    """The hashes of every two consecutive nodes; the last run may have one."""
    return F.transform(F.sequence(F.lit(0), ((F.size(level) - 1) / 2).cast("int")), lambda i: F.sha2(F.array_join(F.slice(level, i * 2 + 1, F.lit(2)), ""), 256))


def collapse(nodes: Column, height: Column) -> Column:
    """All levels of a block, array<array<string>>: its nodes, then `height` levels of hashes."""
    up = F.aggregate(F.sequence(F.lit(1), height), F.array(nodes), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1)))))
    return F.when(height == 0, F.array(nodes)).otherwise(up)


def _blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (g, pos, total, hash and what is carried) to one row for each block: g, block, total, items, levels.

    A group of more than one block collapses LEVELS levels in each of them, the last one too, where a lone node is
    hashed by itself; a group of one block collapses to its root.
    """
    slot = F.pmod("pos", F.lit(1 << LEVELS)).cast("int").alias("slot")
    dealt = nodes.select("g", "total", F.shiftright("pos", LEVELS).alias("block"), F.struct(slot, "hash", *carried).alias("item"))
    packed = dealt.groupBy("g", "block").agg(F.max("total").alias("total"), F.array_sort(F.collect_list("item")).alias("items"))
    height = F.when(F.col("total") == 1, 0).when(F.col("total") > 1 << LEVELS, LEVELS).otherwise(F.length(F.bin(F.col("total") - 1)))
    return cut(packed.withColumn("levels", collapse(F.transform("items", lambda x: x["hash"]), height)))


def _root(levels: Column) -> Column:
    return F.element_at(F.element_at(levels, -1), 1)


def build(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks, from the leaves up, and the root of each group: (g, root)."""
    rounds, roots = [_blocks(nodes, carried)], None
    while True:
        last = rounds[-1]
        done = last.where(F.col("total") <= 1 << LEVELS).select("g", _root(F.col("levels")).alias("root"))
        roots = done if roots is None else roots.union(done)
        more = last.where(F.col("total") > 1 << LEVELS)
        if more.isEmpty():
            return rounds, roots
        up = more.select("g", F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << LEVELS)).alias("total"), _root(F.col("levels")).alias("hash"))
        rounds.append(_blocks(up, ["pos"]))


def _inner_path(item: Column, levels: Column) -> Column:
    """The sibling of an item at each level of its block (null where its run has no other node), and whether the item comes second."""

    def step(i: Column) -> Column:
        at = F.call_function("shiftright", item["slot"], i)
        return F.struct(F.get(F.get(levels, i), at.bitwiseXOR(1)).alias("sibling"), (at.bitwiseAND(1) == 1).alias("second"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), step)).otherwise(F.array().cast("array<struct<sibling:string,second:boolean>>"))


def _opened(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row for each item of the blocks: g, the item's fields, its path to the root and the group's root."""
    joined = _attach(blocks, above, ["g", "block"])
    item = F.transform("items", lambda x: F.struct(x.alias("item"), F.concat(_inner_path(x, F.col("levels")), F.col("path")).alias("path")))
    return joined.select("g", "subroot", F.inline(item)).select("g", "subroot", "item.*", "path")


def open_tree(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves with their paths; top: (g, path, subroot), the way from each group's root on."""
    found = None
    for blocks in reversed(rounds):
        single = blocks.where(F.col("total") <= 1 << LEVELS).select("g", "block")
        above = _attach(single, top, ["g"]).select("g", "block", "path", "subroot")
        if found is not None:
            above = above.union(found.select("g", F.col("pos").alias("block"), "path", "subroot"))
        found = _opened(blocks, above)
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, p: F.when(p["sibling"].isNull(), digest(node)).when(p["second"], digest(p["sibling"], node)).otherwise(digest(node, p["sibling"])))


def proof_hash(path: Column) -> Column:
    """The hash of a path's siblings, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda p: p["sibling"]), ""), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", claimed: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, leaf, claimed, subroot, root, path.

    `path` leads from the leaf to the root: array<struct<sibling, second>>. `claimed` is a leaf that somebody holds for
    the row's, an expression over docs (the leaf itself without it): fold(claimed, path) equals root only if it is right.
    """
    own = leaf_hash(*[F.col(f) for f in fields])
    slim = cut(docs.select(F.col(id_col).alias("doc_id"), _group_key(F.col(group_col)).alias("g"), own.alias("hash"), claimed.alias("claimed") if claimed is not None else F.lit(None).cast("string").alias("claimed")))
    leaves = number(slim, ["doc_id", "hash"])
    uncut(slim)
    rounds, roots = build(leaves, ["doc_id", "claimed"])
    uncut(leaves)
    tops = number(cut(roots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("hash"))), ["name"])
    top_rounds, top_root = build(tops, ["name"])
    root = top_root.first()  # one row, or none
    everything = F.lit(root["root"] if root else None).cast("string")
    start = top_root.select("g", F.array().cast("array<struct<sibling:string,second:boolean>>").alias("path"), F.col("root").alias("subroot"))
    named = open_tree(top_rounds, start).select(F.col("name").alias("g"), "path", F.col("hash").alias("subroot"))
    out = open_tree(rounds, cut(named))
    return out.select("doc_id", F.col("hash").alias("leaf"), F.coalesce("claimed", "hash").alias("claimed"), "subroot", everything.alias("root"), "path")


def tampered(id_col: str = "doc_id", chars_col: str = "n_chars", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf with one more in `chars_col`, for rows whose id's crc32 is divisible by seven; null for others."""
    changed = [F.col(f) + 1 if f == chars_col else F.col(f) for f in fields]
    return F.when(F.crc32(F.col(id_col).cast("string")) % 7 == 0, leaf_hash(*changed))


def audit(docs: DataFrame) -> DataFrame:
    """Holds a copy of docs with some tampered rows against their manifest."""
    out = manifest(docs, claimed=tampered()).withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
