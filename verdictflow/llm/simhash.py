"""SimHash near-duplicates with tiled exact comparison of fingerprints.

Fingerprints are those of word shingles, repeats included; a bit is 1 if it is set in over half of
the shingles' XXH64 values. Equal fingerprints are merged first, so a group of copies is one row.
Two fingerprints within `radius` bits agree wholly on two of radius + 2 blocks of bits, so each is
dealt out by every pair of blocks and compared with those of the same value: in tiles sorted by
population count, by numpy exclusive-or and bit counts, skipping tile pairs whose population counts
differ beyond the radius. No link is lost. A value shared by more than HOT fingerprints is dealt
out again by blocks of its remaining bits, until its groups are small or so few bits remain that
they must be. A group emits a spanning forest of its links, never all pairs, and connected
components follow.

near_dedup() joins texts of an exact five-word Jaccard similarity; equal word sequences are one node. Its candidates
are, first, the SimHash links of the sets' fingerprints and each text's most alike partner, and, once those that
hold have joined their texts, every pair still in two components that can be similar. Two sets of that similarity
share one of the rarest shingles of each (a prefix filter), so texts are dealt out by those, rarest by a count over
all texts; inside a group, tiles of parity sketches are compared by exclusive-or and bit counts, and pairs are left
out only where sizes, places in the order or parities rule the similarity out. No link is lost.

Defined results: null or wordless text has fingerprint zero and links like any other; fewer words
than a shingle make one shingle; rows that repeat an id are one node; a null id stands alone unless
its fingerprint links it; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import attach, attach_bounded, cut, frugal, release, small_batches, uncut

SEED = 42
TILE = 1024
HOT = 20_000
CHUNK = 1 << 13
LEAST_FREE_BITS = 14
SHINGLE_WORDS, NEAR_SHARE = 5, 0.8
#: Bits in which fingerprints of near_dedup()'s first candidates may differ; exact checks and the prefix filter follow.
FIRST_BITS = 3
#: Texts of a shingle from which on it is ordered by its count, and shingles so ordered: the commonest. Any order gives the same links.
RARE, COMMON = 8, 1 << 20
#: Classes of shingles whose parities bound how far two sets differ, in first and last comparisons, and texts of a tile.
PARITY, FINE, PAIR_TILE = 512, 2048, 512
#: Texts of a token's group that is compared whole in every round, and cells of a matrix of a larger one.
FEW, CELLS = 8, 1 << 20
#: Rows of a token's group, about; a larger one is dealt out by pairs of blocks.
GROUP_ROWS = 20_000
#: Links to one text from which on its row is dealt out over salted tasks.
HUB = 64
#: Rows of (id, count) that are broadcast at most.
SMALL = 200_000


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, from the highest."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(axis=0, dtype=np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(w: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The hashes of the word shingles, CHUNK at a time; fewer words make one shingle."""
    line, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(w) - words + 1)]
    stops = ends[min(words, len(w)) - 1 :]
    for i in range(0, len(starts), CHUNK):
        at = zip(starts[i : i + CHUNK].tolist(), stops[i : i + CHUNK].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in at], dtype=np.uint64)


def shingle_hashes(w: list[bytes], words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted hashes of the distinct word shingles; none without words."""
    return np.unique(np.concatenate(list(_hashes(w, words)))) if w else np.zeros(0, np.uint64)


def _fingerprint_of(hashes: Iterable[np.ndarray], n: int) -> int:
    return int.from_bytes(np.packbits(sum(map(_counts, hashes)) * 2 > n).tobytes(), "big") if n else 0


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles; CHUNK of them are in memory at a time."""
    w = _words(text)
    return _fingerprint_of(_hashes(w, words), max(1, len(w) - words + 1)) if w else 0


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    @frugal
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in b], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp(text_col).alias("fp"))


def block_masks(free: int, radius: int, clean: int) -> list[int]:
    """Masks of every choice of `clean` among radius + clean blocks of the free bits."""
    bits = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits), radius + clean)]
    return [sum(c) for c in combinations([b for b in blocks if b], clean)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Forest:
    """Union-find over the rows of one group; the smaller row index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def tile_pairs(pop: np.ndarray, radius: int, tile: int = TILE) -> Iterator[tuple[int, int]]:
    """Starts of the tile pairs of sorted population counts that can hold a link: others differ by more than the radius."""
    for i in range(0, len(pop), tile):
        high = pop[min(i + tile, len(pop)) - 1]
        for j in range(i, len(pop), tile):
            if pop[j] - high > radius:
                break
            yield i, j


def tiled_links(fps: np.ndarray, radius: int, tile: int = TILE) -> list[tuple[int, int]]:
    """A spanning forest, as index pairs, of the links among fingerprints (uint64) within the radius."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    fps = fps[order]
    forest, found = _Forest(len(fps)), []
    for i, j in tile_pairs(pop[order].astype(np.int16), radius, tile):
        near = np.bitwise_count(fps[i : i + tile, None] ^ fps[None, j : j + tile]) <= radius
        for x, y in zip(*np.nonzero(near)):
            if i + x < j + y and forest.join(i + int(x), j + int(y)):
                found.append((int(order[i + x]), int(order[j + y])))
    return found


def _edges(radius: int):
    """Rows sorted by (mask, value) to edges between the representatives of each group."""
    columns = ("mask", "value", "fp", "rep")

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        held = None
        for b in batches:
            own = tuple(b[c].to_numpy(dtype=np.int64) for c in columns)
            held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own))
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            at = int(np.argmax(last))  # sorted: the rows of the last group, which may go on
            if at:
                yield tuple(x[:at] for x in held)
                held = tuple(x[at:] for x in held)
        if held is not None:
            yield held

    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for mask, value, fp, rep in groups(batches):
            found: list[tuple[int, int]] = []
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
            starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(mask)]])
            u = fp.view(np.uint64)
            size = stops - starts
            two = starts[size == 2]
            near = two[np.bitwise_count(u[two] ^ u[two + 1]) <= radius]
            found += zip(near.tolist(), (near + 1).tolist())
            for s, e in zip(starts[size > 2].tolist(), stops[size > 2].tolist()):
                found += [(s + i, s + j) for i, j in tiled_links(u[s:e], radius)]
            a, b = np.array(found, dtype=np.int64).reshape(-1, 2).T
            yield pd.DataFrame({"a": rep[a], "b": rep[b]})

    return run


def links(nodes: DataFrame, radius: int, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (fp, rep) to the edges of a graph whose components are those of all links."""
    columns = ["fp", "rep"]
    masks = [signed(m) for m in block_masks((1 << 64) - 1, radius, 2)]
    dealt = nodes.withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
    out = None
    while True:
        keyed = dealt.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        counts = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        large = cut(counts)
        free = sorted({r["mask"] for r in large.select("mask").distinct().collect()})  # bounded by the number of masks
        refine = {m: block_masks(~m & ((1 << 64) - 1), radius, 1) for m in free if bin(~m & ((1 << 64) - 1)).count("1") > LEAST_FREE_BITS}
        if refine:
            split = large.where(F.col("mask").isin(list(refine)))
            ready = attach(keyed, split, ["mask", "value"], ["fp"]).where("n is null").drop("n")
        else:
            ready = keyed
        part = ready.select("mask", "value", *columns).repartition("mask", "value").sortWithinPartitions("mask", "value", "fp", "rep").mapInPandas(_edges(radius), "a long, b long")
        part = cut(part)
        out = part if out is None else out.unionByName(part)
        if not refine:
            return out
        rows = cut(attach(keyed, split, ["mask", "value"], ["fp"], "inner").select(*columns, "mask"))
        finer = [(m, signed((m & ((1 << 64) - 1)) | f)) for m, fs in refine.items() for f in fs]
        finer = F.broadcast(rows.sparkSession.createDataFrame(finer, "mask long, finer long"))
        dealt = cut(rows.join(finer, "mask").select(*columns, F.col("finer").alias("mask")).distinct())


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    with small_batches(docs.sparkSession):
        rows = cut(fingerprints(docs, words, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    known = nodes.where("rep is not null")
    found = components(links(known.select("fp", "rep"), radius, hot))
    # Only groups that change a row's component are joined back.
    named = cut(nodes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n", "rep").where("n > 1 or component_id <> rep or rep is null").select("fp", "component_id"))
    out = attach(rows, named, ["fp"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _needs(share: float, n: np.ndarray, m: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles that share at most `shared` can have the similarity `share`."""
    return shared * (1 + share) >= share * (n + m) - 1e-6


def _node(w: list[bytes]) -> int:
    return signed(xxhash.xxh3_64_intdigest(b" ".join(w)))


def node_of(text_col: str) -> Column:
    """The hash of the text's words that near_rows() calls node."""

    @F.pandas_udf("long")
    @frugal
    def node(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([_node(_words(t)) for t in b], dtype=np.int64)

    return node(text_col)


def _sets(text_col: str) -> Column:
    @F.pandas_udf("array<long>")
    @frugal
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([shingle_hashes(_words(t)).view(np.int64) for t in b])

    return hashes(text_col)


def _prefix(own: np.ndarray, share: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a set's shingles, rarest first, one of which a set of that similarity must share."""
    n, known = len(own), np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        known = np.where(common[at] == own, counts[at], 0)
    k = min(n, n - int(np.ceil(share * n - 1e-6)) + 1)
    return own[np.lexsort((own, known))[:k]]


def common_shingles(docs: DataFrame, share: float, text_col: str, rare: int = RARE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than `rare` texts have in a prefix by hash, sorted, and their counts: the commonest `most`.

    All texts are counted. The result only orders the shingles of the prefixes that are compared: any order gives the
    same links, a rare-first one fewer candidates.
    """
    none = np.zeros(0, np.int64)

    @frugal
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out = [none]
            for t in b["body"]:
                w = _words(t)
                if (node := _node(w)) not in seen:
                    seen.add(node)
                    out.append(_prefix(shingle_hashes(w).view(np.int64), share, none, none))
            yield pd.DataFrame({"token": np.concatenate(out)})

    counted = docs.select(F.col(text_col).alias("body")).mapInPandas(tokens, "token long").groupBy("token").agg(F.count("*").alias("n"))
    counts = cut(counted.where(F.col("n") > rare))
    # A sort with a limit would bring `most` rows of every task to the driver.
    levels = counts.groupBy(F.floor(F.log2("n") * 8).alias("level")).count().orderBy(F.col("level").desc()).collect()  # a few hundred
    total = np.cumsum([r["count"] for r in levels])
    least = next((r["level"] + 1 for r, t in zip(levels, total) if t > most), -1)
    # As Arrow the driver holds two numbers a shingle, 16 MB at most; rows of Python objects would be many times that.
    got = counts.where(F.floor(F.log2("n") * 8) >= least).select("token", "n").toArrow()
    uncut(counts)
    token, n = got["token"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _parities(s: np.ndarray, classes: int) -> bytes:
    """Of each class of shingles, whether the set has an odd number of it."""
    odd = np.bincount((s % np.uint64(classes)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def near_rows(docs: DataFrame, share: float, common: np.ndarray, counts: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, node, size, fp, bits, fine, prefix): t is a hash of the text, node one of its words, size the number of
    distinct five-word shingles, fp their SimHash, bits and fine their parities, prefix the shingles to be dealt out by."""

    @F.pandas_udf("node long, size int, fp long, bits binary, fine binary, prefix array<long>")
    @frugal
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b:
                w = _words(t)
                s = shingle_hashes(w)
                fp = _fingerprint_of((s[i : i + CHUNK] for i in range(0, len(s), CHUNK)), len(s))
                out.append((_node(w), len(s), signed(fp), _parities(s, PARITY), _parities(s, FINE), _prefix(s.view(np.int64), share, common, counts)))
            yield pd.DataFrame(out, columns=["node", "size", "fp", "bits", "fine", "prefix"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), read(text_col).alias("x"))
    return rows.select("doc_id", "t", "x.*")


def _block_key(token: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A new token for each pair of blocks of a hot one."""
    with np.errstate(over="ignore"):
        return token ^ ((low * 0x9E3779B97F4A7C1 + high + 1) * np.int64(0x2545F4914F6CDD1D))


def _tokens(common: np.ndarray, counts: np.ndarray, share: float, group_rows: int = GROUP_ROWS):
    """Rows (node, size, prefix), each node once a task, to (token, side, node, size, tail).

    tail is how many shingles are left from the token on. A token that about `group_rows` texts or more have is
    dealt out by pairs of blocks of texts, as tokens of their own: each text meets every block once, so no pair is
    lost and no group grows beyond two blocks. side tells the two blocks of a pair apart; it is 0 in whole groups.
    """
    blocks = np.ceil(counts / (1 - share) / group_rows).astype(np.int64)  # the counts are of prefixes, a part of all texts
    hot = {t: int(b) for t, b in zip(common[blocks > 1].tolist(), blocks[blocks > 1].tolist())}

    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out = [(np.zeros(0, np.int64),) * 5]
            for node, n, prefix in zip(b["node"].tolist(), b["size"].tolist(), b["prefix"]):
                if node in seen:
                    continue
                seen.add(node)
                token = np.asarray(prefix, np.int64)
                tail, side = n - np.arange(len(token)), np.zeros(len(token), np.int64)
                for at in [i for i, t in enumerate(token.tolist()) if t in hot] if hot else []:
                    k = hot[int(token[at])]
                    own, other = np.full(k, node % k), np.arange(k)
                    keys = _block_key(np.full(k, token[at]), np.minimum(own, other), np.maximum(own, other))
                    token, tail = np.append(token, keys), np.append(tail, np.full(k, tail[at]))
                    side = np.append(side, np.sign(own - other) % 3)  # -1 and 1 become 2 and 1
                if hot:
                    whole = np.array([t not in hot for t in token.tolist()], bool)
                    token, tail, side = token[whole], tail[whole], side[whole]
                out.append((token, side, np.full(len(token), node), np.full(len(token), n), tail))
            yield pd.DataFrame(dict(zip(("token", "side", "node", "size", "tail"), (np.concatenate(x) for x in zip(*out)))))

    return run


def _token_groups(batches: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Rows sorted by token and node, each once, in pieces of whole groups: columns, starts and stops of the groups."""
    held: list[pd.DataFrame] = []

    def ready(frames: list[pd.DataFrame]):
        f = pd.concat(frames, ignore_index=True)
        token, node = f["token"].to_numpy(), f["node"].to_numpy()
        once = np.ones(len(f), bool)
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        f, token = f[once], token[once]
        at = np.flatnonzero(np.diff(token)) + 1
        return [f[c].to_numpy() for c in columns], np.concatenate([[0], at]), np.concatenate([at, [len(token)]])

    for b in batches:
        if not len(b):
            continue
        token = b["token"].to_numpy()
        at = int(np.argmax(token == token[-1]))  # sorted: the rows of the last group, which may go on
        if at or (held and held[-1]["token"].iat[-1] != token[-1]):
            yield ready([*held, b.iloc[:at]])
            held = []
        held.append(b.iloc[at:])
    if held:
        yield ready(held)


def _few_pairs(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the groups of at most FEW rows."""
    out = []
    for g in range(2, FEW + 1):
        own = starts[stops - starts == g][:, None]
        x, y = np.triu_indices(g, 1)
        out.append(((own + x).ravel(), (own + y).ravel()))
    x, y = (np.concatenate(z) for z in zip(*out))
    return x, y


def _apart(label_x, label_y, side_x, side_y) -> np.ndarray:
    """Whether texts lie in different components and, in a pair of blocks, in different blocks."""
    return (label_x != label_y) & ((side_x == 0) | (side_x != side_y))


def _live(share: float, labelled: bool):
    """The rows whose size and place allow the similarity to another text of the token, of another component if `labelled`."""
    columns = ("token", "side", "node", "size", "tail", *["label"] * labelled)

    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols, starts, stops in _token_groups(batches, columns):
            side, size, tail, label = cols[1], cols[3].astype(np.int64), cols[4].astype(np.int64), cols[-1 if labelled else 2]
            keep = np.zeros(len(size), bool)
            x, y = _few_pairs(starts, stops)
            ok = _apart(label[x], label[y], side[x], side[y]) & _needs(share, size[x], size[y], np.minimum(tail[x], tail[y]))
            keep[x[ok]] = keep[y[ok]] = True
            large = stops - starts > FEW
            for s, e in zip(starts[large].tolist(), stops[large].tolist()):
                if (label[s:e] == label[s]).all():
                    continue
                step = max(1, CELLS // (e - s))
                for i in range(s, e, step):
                    a = slice(i, min(i + step, e))
                    can = _needs(share, size[a, None], size[None, s:e], np.minimum(tail[a, None], tail[None, s:e]))
                    keep[a] = (can & _apart(label[a, None], label[None, s:e], side[a, None], side[None, s:e])).any(axis=1)
            yield pd.DataFrame({c: x[keep] for c, x in zip(columns, cols)})

    return run


def tiled_pairs(node: np.ndarray, size: np.ndarray, tail: np.ndarray, label: np.ndarray, side: np.ndarray, bits: np.ndarray, share: float, tile: int = PAIR_TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of one token's texts that lie in different components and can have the similarity, and the bits in
    which their parities differ, tile by tile.

    No pair of that similarity is left out at the first token it shares: from there on both must have shingles
    enough, and classes of odd count differ by no more than the shingles. Tiles are skipped where their sizes, or the
    population counts of their parities, differ too much for any of their pairs.
    """
    pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    order = np.lexsort((node, size))
    size, tail, label, side, bits, pop = size[order].astype(np.int64), tail[order].astype(np.int64), label[order], side[order], bits[order], pop[order]
    n = len(order)
    for i in range(0, n, tile):
        a = slice(i, min(i + tile, n))
        for j in range(i, n, tile):
            b = slice(j, min(j + tile, n))
            if size[j] * share > size[a][-1] + 1e-6:
                break
            gap = max(pop[a].min() - pop[b].max(), pop[b].min() - pop[a].max(), 0)
            if not _needs(share, size[a][-1], size[b][-1], (size[a][-1] + size[b][-1] - gap) / 2):
                continue
            ok = _apart(label[a, None], label[None, b], side[a, None], side[None, b])
            ok &= _needs(share, size[a, None], size[None, b], np.minimum(tail[a, None], tail[None, b]))
            x, y = np.nonzero(np.triu(ok, 1) if i == j else ok)
            x, y = x + i, y + j
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
            can = _needs(share, size[x], size[y], (size[x] + size[y] - apart) / 2)
            yield order[x[can]], order[y[can]], apart[can]


def _nearest(x: np.ndarray, y: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (x, y) at distance far, in both directions, the nearest for each text."""
    u, v, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([far, far])
    by = np.lexsort((v, d, u))
    u, v, d = u[by], v[by], d[by]
    top = np.ones(len(u), bool)
    top[1:] = u[1:] != u[:-1]
    return u[top], v[top], d[top]


def _pairs(share: float, whole: bool):
    """Rows sorted by token and node to pairs by tiled_pairs(): (a, b), a > b, or without `whole`, for each text its
    nearest partner (a, b, far) by the share of shingles that differ, as the parities tell it."""

    @frugal
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (side, node, size, tail, label, bits), starts, stops in _token_groups(batches, ("side", "node", "size", "tail", "label", "bits")):
            own = np.frombuffer(b"".join(bits), dtype=np.uint64).reshape(len(node), -1)
            long, last = size.astype(np.int64), tail.astype(np.int64)
            x, y = _few_pairs(starts, stops)
            ok = _apart(label[x], label[y], side[x], side[y]) & _needs(share, long[x], long[y], np.minimum(last[x], last[y]))
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(own[x] ^ own[y]).sum(axis=1, dtype=np.int64)
            ok = _needs(share, long[x], long[y], (long[x] + long[y] - apart) / 2)
            found = [(x[ok], y[ok], apart[ok] / (long[x[ok]] + long[y[ok]]))]
            large = stops - starts > FEW
            for s, e in zip(starts[large].tolist(), stops[large].tolist()):
                if (label[s:e] == label[s]).all():
                    continue
                group = [(x + s, y + s, d / (long[x + s] + long[y + s])) for x, y, d in tiled_pairs(node[s:e], size[s:e], tail[s:e], label[s:e], side[s:e], own[s:e], share)]
                found += group if whole or not group else [_nearest(*(np.concatenate(z) for z in zip(*group)))]
            x, y, far = (np.concatenate(z) for z in zip(*found))
            if whole:
                yield pd.DataFrame({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])}).drop_duplicates()
            else:
                x, y, far = _nearest(node[x], node[y], far)
                yield pd.DataFrame({"a": x, "b": y, "far": far})

    return run


def similar(edges: DataFrame, docs: DataFrame, share: float, text_col: str) -> DataFrame:
    """Those of the edges (a, b) of near_rows() nodes whose shingle sets have a Jaccard similarity of `share`."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    degree = cut(ends.groupBy("node").agg(F.count("*").alias("degree")))
    texts = docs.select(node_of(text_col).alias("node"), F.col(text_col).alias("body"))
    texts = attach_bounded(texts, degree, ["node"], None, "inner", SMALL).groupBy("node", "degree").agg(F.first("body").alias("body"))
    sets = cut(texts.select("node", "degree", _sets("body").alias("s")))
    few = sets.select(F.col("node").alias("a"), F.col("degree").alias("da"), F.col("s").alias("sa"))
    many = sets.select(F.col("node").alias("b"), F.col("degree").alias("db"), F.col("s").alias("sb"))
    # The end of fewer links is joined first, so what is dealt out by it is never hot.
    d = degree.select("node", "degree")
    sided = edges.join(d.toDF("a", "da").hint("merge"), "a").join(d.toDF("b", "db").hint("merge"), "b")
    turned = F.struct("da", "a") > F.struct("db", "b")
    sided = cut(sided.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("da", "db").alias("db")))
    left = sided.join(few.drop("da").hint("merge"), "a")
    hot = attach(left.where(F.col("db") > HUB).drop("db"), many.where(F.col("db") > HUB).drop("db"), ["b"], ["a"], "inner")
    cold = left.where(F.col("db") <= HUB).drop("db").join(many.where(F.col("db") <= HUB).drop("db").hint("merge"), "b")
    both = hot.unionByName(cold).withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    true = both.where(F.col("shared") >= share * (F.size("sa") + F.size("sb") - F.col("shared")) - 1e-9)
    out = cut(true.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    uncut(degree, sets, sided)
    return out


def _first_links(rows: DataFrame) -> DataFrame:
    """(a, b), a > b: nodes of equal SimHash to the smallest of them, and links of those within FIRST_BITS."""
    named = cut(rows.groupBy("fp", "node").agg(F.lit(1)).select("fp", "node"))
    heads = cut(named.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")))
    equal = attach(named, heads.where("n > 1").drop("n"), ["fp"], None, "inner").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    close = links(heads.select("fp", "rep"), FIRST_BITS)
    out = cut(equal.unionByName(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    uncut(named, heads, close)
    return out


def text_groups(rows: DataFrame, docs: DataFrame, share: float, text_col: str, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(node, component) of the near_rows() nodes that a chain of links of exact similarity `share` joins to another."""
    kinds = "token long, side int, node long, size int, tail int"
    by_token = lambda df, f, schema: df.repartition("token").sortWithinPartitions("token", "node").mapInPandas(f, schema)
    live = cut(by_token(rows.select("node", "size", "prefix").mapInPandas(_tokens(common, counts, share), kinds), _live(share, False), kinds))
    release(live.sparkSession)
    bits = cut(rows.groupBy("node").agg(F.first("bits").alias("bits"), F.first("fine").alias("fine")))
    # SimHash links and one link of each text join most of a group; then every pair that is still in two components is compared.
    known = live.withColumn("label", F.col("node")).join(bits.drop("fine").hint("merge"), "node")
    near = by_token(known, _pairs(share, False), "a long, b long, far double").groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    first = _first_links(rows)
    tried = cut(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).unionByName(first).where("a > b").distinct())
    release(live.sparkSession)
    true = similar(tried, docs, share, text_col)
    joined = components(true)
    uncut(first, true)
    release(live.sparkSession)
    known = live.join(joined.hint("merge"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    rest = cut(by_token(known, _live(share, True), f"{kinds}, label long"))
    uncut(live)
    open_pairs = by_token(rest.join(bits.select("node", F.col("fine").alias("bits")).hint("merge"), "node"), _pairs(share, True), "a long, b long")
    left = cut(open_pairs.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
    uncut(rest, bits, tried)
    release(live.sparkSession)
    more = similar(left, docs, share, text_col)
    out = components(joined.toDF("a", "b").unionByName(more))
    uncut(left, more, joined)
    return out


def _placed(docs: DataFrame, share: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, t, n, component) of the rows' ids and texts, n rows each; a text that no link joins is its own component."""
    with small_batches(docs.sparkSession):
        common, counts = common_shingles(docs, share, text_col)
        rows = cut(near_rows(docs, share, common, counts, id_col, text_col))
        found = text_groups(rows, docs, share, text_col, common, counts)
        own = rows.groupBy("doc_id", "t", "node").agg(F.count("*").alias("n"))
        out = cut(own.join(found.hint("merge"), "node", "left").select("doc_id", "t", "n", F.coalesce("component", "node").alias("component")))
    uncut(rows, found)
    release(docs.sparkSession)
    return out


def near_groups(docs: DataFrame, share: float = NEAR_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, component): ids that a chain of links of exact similarity `share` joins to a smaller id, the smallest.

    Texts without words are alike; a null id is in no group.
    """
    placed = _placed(docs.where(F.col(id_col).isNotNull()), share, id_col, text_col)
    heads = placed.groupBy("component").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = attach(placed.select("doc_id", "component"), cut(heads), ["component"], None, "inner")
    return components(stars.select(F.col("doc_id").alias("a"), F.col("head").alias("b")))


def near_dedup(docs: DataFrame, share: float = NEAR_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs of each group of near texts, that of the smallest id, a null id being last.

    Rows are judged by their own text: one id may have several texts, and of rows of one id and text any stays.
    """
    placed = _placed(docs, share, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    heads = placed.groupBy("component").agg(F.min(order).alias("head"), F.sum("n").alias("rows")).where("rows > 1").select("component", "head")
    marked = attach(placed, cut(heads), ["component"], None, "inner").withColumn("_kept", order.eqNullSafe(F.col("head")))
    marked = cut(marked.where("n > 1 or not _kept").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "_kept"))
    uncut(placed)
    sized = (lambda m: F.broadcast(m)) if marked.limit(SMALL + 1).count() <= SMALL else (lambda m: m.hint("merge"))
    rows = docs.withColumn("_text", F.xxhash64(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t"))
    out = rows.join(sized(marked), same, "left_anti").select(*docs.columns)
    if not marked.where("_kept").limit(1).count():
        return out
    twice = rows.join(sized(marked.where("_kept")), same, "left_semi").dropDuplicates([id_col, "_text"])
    return out.unionByName(twice.select(*docs.columns))
