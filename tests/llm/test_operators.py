"""Each corpus operator against a brute-force form, on rows with nulls, ties, copies and clashing columns."""

import base64
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictflow.llm import _components, decontamination, exact_dedup, html_extract, lang_id, line_dedup, mixing, quality, sharding, simhash, warc
from verdictflow.llm._components import components
from verdictflow.llm._shared import held_out, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size int, fp string, w string, text_sha256 int, row int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def _texts():
    r = random.Random(3)
    vocabulary = {"aa": ["kalo", "miru", "tesa", "vona"], "bb": ["xyzzy", "qwrt", "plugh", "zzyk"]}
    out = []
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        words = [r.choice(vocabulary[lang]) + r.choice(["", "n", "s"]) for _ in range(r.randint(1, 60))]
        text = " ".join(words) + ("\nShared line here" if i % 4 == 0 else "")
        out.append((i, text, lang, f"s{i % 5}"))
    for i in range(120, 150):  # copies
        out.append((i, out[7][1] if i % 2 else out[8][1] + "  \t", "aa", f"s{i % 10}"))
    return [*out, (150, None, None, None), (151, "", "aa", None), (152, " \n\t ", None, "s1"), (None, "no id", "aa", "s2"), (153, "1234 !!", "bb", "s3"), (154, "x" * 40_000 + " " + "y z " * 9_000, "aa", "s3"), (7, out[7][1], "aa", "s2"), (7, out[7][1], "aa", "s2"), (155, "½ Ⅷ", "aa", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), 0.5, "k", 1, "f", "w", 3, 4) for i, t, lang, s in _texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _norm(text):
    return SPACE.sub(" ", text or "")


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    groups = defaultdict(list)
    for i, t, *_ in _texts():
        groups[_norm(t)].append(i)
    want = Counter((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert exact_dedup.exact_dedup(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=300))
def test_cuckoo_index_is_a_map(steps):
    index, model = exact_dedup.CuckooIndex(bits=1), {}
    for add, n in steps:
        digest = hashlib.sha256(str(n).encode()).digest()
        if add:
            assert index.add(digest, n) == (digest not in model)
            model[digest] = [n, 0, model.get(digest, [n, 0, 0])[2] + 1]
        else:
            assert index.delete(digest) == model.pop(digest, None)
        assert dict(index.items()) == model and index.size == len(model)


def test_cuckoo_index_resizes_from_its_keys():
    index = exact_dedup.CuckooIndex(bits=1)
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(2000)]
    assert all(index.add(k, i) for i, k in enumerate(keys)) and index.resizes
    assert all(index.get(k) == [i, 0, 1] for i, k in enumerate(keys))
    index.add(keys[5], None, 2, 1)
    index.add(keys[5], 5, 1, -1)
    assert index.get(keys[5]) == [5, -1, 4] and index.add(b"n" * 32, None, 1, 7) and not index.add(b"n" * 32, 3, 1, 9) and index.get(b"n" * 32) == [3, 9, 2]


def _fingerprint(text, n=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize(("radius", "hot"), [(2, 20_000), (2, 3), (6, 20_000)])
def test_simhash_groups(docs, radius, hot):
    rows = simhash.simhash_groups(docs, radius=radius, hot=hot).collect()
    data = [(i, _fingerprint(t)) for i, t, *_ in _texts()]
    assert Counter((r.doc_id, r.fingerprint) for r in rows) == Counter((i, f"{f:016x}") for i, f in data)
    label = {k: k for k in range(len(data))}
    for _ in data:
        for a, b in itertools.combinations(range(len(data)), 2):
            if (data[a][1] ^ data[b][1]).bit_count() <= radius or (data[a][0] is not None and data[a][0] == data[b][0]):
                label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in itertools.combinations(range(len(data)), 2) if (data[a][1] ^ data[b][1]).bit_count() <= radius):
            break
    group = defaultdict(list)
    for k, x in label.items():
        group[x].append(data[k][0])
    want = Counter((data[k][0], min((i for i in group[x] if i is not None), default=None)) for k, x in label.items())
    assert Counter((r.doc_id, r.component_id) for r in rows) == want


def _jaccard(a, b):
    cut = lambda t: {" ".join(w[i : i + 5]) for w in [(t or "").lower().split()] if w for i in range(max(1, len(w) - 4))}
    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y) if x | y else 1


def _near_groups(data):
    """Smallest id of each id's group, by all pairs."""
    data = [(i, t) for i, t in data if i is not None]
    forest = simhash._Forest(len(data))
    for a, b in itertools.combinations(range(len(data)), 2):
        if data[a][0] == data[b][0] or _jaccard(data[a][1], data[b][1]) >= 0.8:
            forest.join(a, b)
    low = {}
    for k, (i, _) in enumerate(data):
        low[forest.root(k)] = min(i, low.get(forest.root(k), i))
    return {i: low[forest.root(k)] for k, (i, _) in enumerate(data)}


def test_simhash_empty_and_stage(docs, empty):
    assert simhash.simhash_groups(empty).count() == 0 and simhash.near_dedup(empty).count() == 0
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    want = _near_groups([(i, t) for i, t, *_ in _texts()])
    assert {r.doc_id for r in kept.collect()} == {i for i, low in want.items() if i == low} | {None}


def test_near_dedup_with_edits(spark):
    r = random.Random(11)
    data, word = [], lambda: "".join(r.choices("abcdefghij", k=4))
    for i in range(12):
        base = [word() for _ in range(r.choice([40, 150, 600]))]
        for c in range(r.choice([1, 4, 25])):
            own = list(base)
            for _ in range(int(len(base) * r.choice([0, 0.01, 0.02, 0.15]))):
                own[r.randrange(len(own))] = word()
            data.append((1000 * i + c, " ".join(own)))
    want = _near_groups(data)
    got = {i: i for i, _ in data} | {x.node: x.component for x in simhash.near_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 12


def _variant(r, base, edits, word):
    own = list(base)
    for _ in range(edits):
        own[r.randrange(len(own))] = word()
    return own


def test_near_dedup_in_a_template_family(spark):
    """Thousands of texts that are near in fingerprint and not in words, each with one real near copy."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    base, data = [word() for _ in range(150)], []
    for i in range(1500):
        own = _variant(r, base, 5, word)
        data += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(_variant(r, own, 1, word)))]
    sets = [np.unique([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)]) for w in (t.split() for _, t in data)]
    at = {h: k for k, h in enumerate(sorted({h for s in sets for h in s.tolist()}))}
    forest, n = simhash._Forest(len(data)), np.array([len(s) for s in sets])
    having = defaultdict(list)
    for k, s in enumerate(sets):
        for h in s.tolist():
            having[at[h]].append(k)
    having = {h: np.array(x) for h, x in having.items()}
    for k, s in enumerate(sets):  # all pairs
        shared = np.bincount(np.concatenate([having[at[h]] for h in s.tolist()]), minlength=len(data))
        for m in np.flatnonzero(shared >= 0.8 * (n + n[k] - shared) - 1e-9).tolist():
            forest.join(k, m)
    want = {k: forest.root(k) for k in range(len(data))}
    got = {k: k for k in want} | {x.node: x.component for x in simhash.near_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 1000


def test_near_pairs_of_one_token_are_whole():
    """Every pair of the similarity passes at the first shingle it shares, in all tiles."""
    r = np.random.default_rng(5)
    base = np.arange(1, 90)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(70, 89), replace=False), r.integers(1000, 9000, r.integers(0, 12)), [0]])) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    bits = np.stack([np.packbits((np.bincount(s % 512, minlength=512) & 1).astype(np.uint8)).view(np.uint64) for s in sets])
    node, label = np.arange(60), np.arange(60) // 2
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) and label[a] != label[b]}
    found = lambda side, tile: {tuple(sorted(p)) for x, y, _ in simhash.tiled_pairs(node, sizes, sizes, label, side, bits, 0.8, tile) for p in zip(x.tolist(), y.tolist())}
    whole = np.zeros(60, np.int64)
    got = found(whole, 7)
    assert want and want <= got and all(label[a] != label[b] for a, b in got)
    assert found(whole, 1) == found(whole, 60) == got  # tiles that are skipped hold no pair
    side = np.arange(60) % 2 + 1
    assert found(side, 7) == {(a, b) for a, b in got if side[a] != side[b]}


def test_nearest_partner_of_each_text():
    x, y, far = np.array([5, 5, 2]), np.array([2, 9, 9]), np.array([0.3, 0.1, 0.2])
    got = {int(u): (int(v), float(d)) for u, v, d in zip(*simhash._nearest(x, y, far))}
    assert got == {5: (9, 0.1), 9: (5, 0.1), 2: (9, 0.2)}


def test_blocks_of_a_hot_shingle_meet_once():
    """Every two texts of a hot shingle stand in one group, on sides that are compared; the group is small."""
    nodes = list(range(100, 140))
    rows = pd.DataFrame({"node": nodes * 2, "size": 10, "prefix": [np.array([7, 1000 + k, 3], np.int64) for k in nodes] * 2})
    out = pd.concat(simhash._tokens(np.array([3, 7]), np.array([1, 8]), 0.8, group_rows=10)([rows]))
    assert 7 not in set(out["token"]) and (out[out["token"] == 3]["side"] == 0).all() and (out["tail"][out["token"] == 3] == 8).all()
    met = Counter()
    for _, g in out[~out["token"].isin([3, *range(1100, 1140)])].groupby("token"):
        assert len(g) <= 20 and set(g["tail"]) == {10}
        for (a, s), (b, t) in itertools.combinations(zip(g["node"], g["side"]), 2):
            met[tuple(sorted((a, b)))] += s == 0 or s != t
    assert met == Counter(itertools.combinations(nodes, 2))


def test_near_dedup_does_not_depend_on_the_order_of_shingles(spark, monkeypatch):
    """Caps on what orders shingles, and blocks of hot ones, change the work and not the groups."""
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(20)]
    data = [(i, " ".join(_variant(r, base, r.choice([0, 1, 2, 3]), word) if i % 2 else [word() for _ in range(70)] + passage)) for i in range(120)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    groups = lambda: {x.node: x.component for x in simhash.near_groups(df).collect()}
    want = {i: c for i, c in _near_groups(data).items() if i != c}
    assert groups() == want and want
    orders, tokens = simhash.common_shingles, simhash._tokens
    monkeypatch.setattr(simhash, "_tokens", lambda common, counts, share: tokens(common, counts, share, 7))
    monkeypatch.setattr(simhash, "common_shingles", lambda d, share, c: orders(d, share, c, 2, 1 << 20))
    assert groups() == want
    monkeypatch.setattr(simhash, "common_shingles", lambda d, share, c: orders(d, share, c, 2, 5))
    assert groups() == want


def test_near_dedup_with_appended_and_replaced_passages(spark):
    """Copies that differ by one passage, of similarities from 0.75 to 0.9; a fingerprint moves too far for some."""
    r = random.Random(23)
    word, data = lambda: "".join(r.choices("abcdefghij", k=5)), []
    for i in range(600):
        base = [word() for _ in range(r.choice([60, 120, 300]))]
        new = [word() for _ in range(int(len(base) * r.uniform(0.03, 0.3)))]
        at = r.randrange(len(base))
        copy = base + new if i % 2 else base[:at] + new[: len(new) // 2] + base[at + len(new) // 2 :]
        data += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    want = {2 * i + 1: 2 * i for i in range(600) if _jaccard(data[2 * i][1], data[2 * i + 1][1]) >= 0.8}
    got = {x.node: x.component for x in simhash.near_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want and 100 < len(want) < 590


def test_near_dedup_judges_rows(spark):
    """Repeated ids, null ids, and an id with two texts."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (1, a), (2, b), (2, a + " more"), (None, c), (None, c), (None, b), (3, d), (None, None), (None, " ")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got = Counter((r.doc_id, (r.text or "").strip()) for r in kept)
    assert got == Counter([(1, a), (2, b), (None, c), (3, d), (None, "")])


def test_tiles_are_skipped_by_population_count():
    """In a group of the size that is still compared whole, most tile pairs differ too much; those left hold all links."""
    pop = np.sort(np.bitwise_count(np.random.default_rng(3).integers(0, 1 << 63, simhash.HOT, dtype=np.uint64))).astype(np.int16)
    tiles = -(-len(pop) // simhash.TILE)
    seen = set(simhash.tile_pairs(pop, 2))
    assert len(seen) < 0.6 * tiles * (tiles + 1) / 2
    for i, j in itertools.combinations(range(0, len(pop), simhash.TILE), 2):
        gap = pop[j] - pop[min(i + simhash.TILE, len(pop)) - 1]
        assert ((i, j) in seen) == (gap <= 2)


def test_tiles_lose_no_link():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in r.integers(0, 63, 5)]]))
    forest = simhash._Forest(len(fps))
    for a, b in itertools.combinations(range(len(fps)), 2):
        if int(fps[a] ^ fps[b]).bit_count() <= 2:
            forest.join(a, b)
    got = simhash._Forest(len(fps))
    for a, b in simhash.tiled_links(fps, 2, tile=7):
        got.join(a, b)
    same = lambda f: [[f.root(i) == f.root(j) for j in range(len(fps))] for i in range(len(fps))]
    assert same(forest) == same(got)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 400), (600, 400), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400, 600: 400}


def test_components_of_stars_take_no_turn(spark, monkeypatch):
    """What is settled is seen by one aggregate; a chain, or two links of one node, are not."""
    turns, star = [], _components._star
    monkeypatch.setattr(_components, "_star", lambda e, large: turns.append(large) or star(e, large))
    got = lambda edges: {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got([(2, 1), (1, 3), (9, 8), (9, 8), (5, 5)]) == {2: 1, 3: 1, 9: 8} and not turns
    assert got([]) == {} and not turns
    assert got([(3, 2), (2, 1)]) == {3: 1, 2: 1} and len(turns) == 2
    assert got([(3, 2), (3, 1)]) == {3: 1, 2: 1} and len(turns) == 4


def test_common_shingles_are_small_on_the_driver(spark):
    """Two numbers a shingle and their sort, no Python objects; sorted, with the counts of all texts."""
    df = spark.range(600).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda x: F.concat(F.lit("w"), x + F.col("id") * 500))).alias("text"))
    simhash.common_shingles(df.limit(2), 0.8, "text", 0)  # what is loaded once does not count
    tracemalloc.start()
    token, n = simhash.common_shingles(df, 0.8, "text", 0)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(token) > 60_000 and (np.diff(token) > 0).all() and n.sum() > 100_000
    assert peak < 80 * len(token)


def test_sharding(docs, empty):
    rows = sharding.shard_table(docs).collect()
    data = _texts()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(8))
    per = defaultdict(set)
    for r in rows:
        per[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in per.values())
    assert sharding.shard_table(empty).count() == 0
    wide = sharding.shard_documents(docs)
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in wide.collect()).total() == len(data) and {"shard", "slot", "text", "score"} <= set(wide.columns)


def test_sharding_balances_bytes(spark):
    r = random.Random(5)
    rows = [(i, "x" * r.randint(1, 400) + str(i)) for i in range(4000)]
    out = sharding.shard_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    load = Counter()
    for x in out:
        load[x.shard] += x["size"]
    assert max(load.values()) < 1.02 * min(load.values())


def test_mixing(docs, empty, spark):
    rows = mixing.mix(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    data = _texts()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, words(t)) for i, t, *_ in data)
    own = Counter()
    for _, t, _, s in data:
        own[s] += words(t)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(own, key=lambda s: (s is None, s)))}
    total, target, capped = 1.5 * sum(own.values()), {}, set()
    while True:
        free = [s for s in own if s not in capped and own[s]]
        level = (total - sum(2 * own[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 2 * own[s]}
        if not over:
            break
        capped |= over
    target = {s: min(2 * own[s], level * weight[s]) for s in own}
    assert {(round(r.target, 6), r.source_size) for r in rows} == {(round(target[s], 6), own[s]) for s in own}
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in rows) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    taken = mixing.mix_documents(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in rows)


def test_mixing_meets_its_targets(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(1, 300), f"s{i % 6}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = Counter(), {}
    for x, (_, _, s) in zip(sorted(out, key=lambda x: x.doc_id), rows):
        taken[s] += x.taken
        target[s] = x.target
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)


def test_line_dedup(docs, empty):
    rows = line_dedup.line_dedup(docs, min_sites=3).collect()
    sites = defaultdict(set)
    for _, t, _, s in _texts():
        for line in (t or "").split("\n") if t is not None else []:
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
    gone = {x for x, s in sites.items() if len(s) >= 3}
    want = Counter()
    for i, t, *_ in _texts():
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if x.strip(" ") not in gone]
        want[i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in rows) == want and "Shared line here" in gone
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_near_the_threshold(spark):
    rows = [(1000 * k + s, f"line {k}\nown {k} {s}", f"site{s}") for k in (27, 28, 29, 30, 31, 60) for s in range(k)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=30).collect()
    assert {r.doc_id // 1000 for r in out if r.n_removed} == {30, 31, 60}


def test_decontamination(docs, empty, spark):
    data = _texts()
    items = [(1, data[10][1]), (2, " ".join(data[11][1].split()[:9])), (3, None), (4, "..."), (5, "kalo!"), (5, "never seen words in any text"), (None, data[13][1]), (6, "alpha beta gamma delta epsilon zeta")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())

    def grams(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = set()
    for item, t in items:
        w = words(t)
        if w:
            own = grams(w, min(5, len(w)))
            want |= {(i, item) for i, text, *_ in data if len(own & grams(words(text), min(5, len(w)))) >= 0.8 * len(own) - 1e-9}
    got = decontamination.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(r.containment >= 0.8 for r in got)
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in data} - {i for i, _ in want}
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.where("false")).count() == 0


def test_decontamination_sees_edited_items(spark):
    item = [f"w{i}" for i in range(60)]
    edited, broken = list(item), list(item)
    edited[30] = "changed"
    for i in range(2, 60, 6):
        broken[i] = "changed"
    rows = [(1, "pad " * 500 + " ".join(edited).upper() + " pad" * 500), (2, " ".join(broken))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in got] == [(1, 9, 51, 56)]


PAGES = "page_id long, url string, html string, digest string, role int, key int"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nx", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "v", "solo"), (5, "w", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "x", "dup"), (6, "x", "dup"), (7, "y", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], PAGES)
    path = scratch_path(spark, "warc-test")
    got = warc.round_trip(pages, path).collect()
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len((h or "").encode()), sha(h)) for i, _, h in rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (None, "response", None), (5, "response", None), (6, "response", None), (6, "revisit", 6), (7, "response", None)])
    records = warc.read_warc(spark, path)
    assert Counter(r.payload.decode() for r in records.where("record_type = 'response'").collect()) == Counter({h or "" for _, _, h in rows})
    captures = warc.assemble(records).collect()
    assert len(captures) == len(rows) and all(c.request.record_id == c.response.concurrent_to and c.metadata.concurrent_to == c.response.record_id for c in captures)
    small = warc.round_trip(pages, scratch_path(spark, "warc-test"), min_revisit_bytes=4).collect()
    assert Counter(r.record_type for r in small if r.page_id in (3, 4, 6)) == Counter({"response": 4})
    assert warc.round_trip(pages.where("false"), scratch_path(spark, "warc-test")).count() == 0


def test_warc_reader_refuses_damage():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse_warc(record * 3)] == [b"ab"] * 3
    for bad in (record[:-1], record[:20], record.replace(b"WARC/1.1", b"XARC/1.1"), record.replace(b"h: 2", b"h: 1")):
        with pytest.raises(warc.WarcError):
            list(warc.parse_warc(bad))


@pytest.fixture(scope="module")
def dom():
    return html_extract.train(300)


def test_html_extract_cases(dom):
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four.</p><p>Of.</p></article><div id="comments"><p>I liked it very much.</p></div><footer>&copy; x'
    assert dom.extract([page]) == ["A & B\nOne two.\nThree four.\nOf."]
    assert dom.extract([None, "", "<", "<<<>>>", "</p></div>"])[:2] == ["", ""]
    assert dom.extract(["<div>" * 3000 + "deep"]) is not None


#: Pages written by hand, in layouts that the generator of training pages does not have, and their texts.
HAND = {
    "table layout": ('<html><body><table width=100%><tr><td colspan=3>Daily Bugle</td></tr><tr><td><a href=/a>Home</a><br><a href=/b>Sports</a><br><a href=/c>World</a></td><td><h1>Storm reaches coast</h1><p>The storm reached the coast on Monday evening, and officials asked people to stay inside.</p><p>More rain is expected tomorrow, forecasters said.</p></td><td><a href=/x>Sponsored: buy boots</a></td></tr><tr><td colspan=3>&copy; 2020 Bugle</td></tr></table></body></html>', "Storm reaches coast\nThe storm reached the coast on Monday evening, and officials asked people to stay inside.\nMore rain is expected tomorrow, forecasters said."),
    "hidden": ('<body><article><h1>Title here</h1><div hidden>You cannot see me at all.</div><p>First paragraph of the article, which is long enough.</p><p style="display:none">Secret text of the page.</p><p>Second <span style="display: none">ghost</span>paragraph.</p></article></body>', "Title here\nFirst paragraph of the article, which is long enough.\nSecond paragraph."),
    "noscript button": ('<body><article><h2>Heading</h2><noscript>Please enable JavaScript to read.</noscript><p>The council voted on the plan after a long debate.</p><button>Share this</button><p>It will start in May.</p></article></body>', "Heading\nThe council voted on the plan after a long debate.\nIt will start in May."),
    "foreign comments": ('<body><nav><a href=/>Start</a> <a href=/n>News</a></nav><article><h1>Neue Br&uuml;cke</h1><p>Die neue Br&uuml;cke wurde am Montag nach langer Bauzeit er&ouml;ffnet und ist nun frei.</p><p>Viele Menschen kamen.</p></article><div id="kommentare"><h3>2 Kommentare</h3><div><b>Max</b><p>Endlich ist sie fertig!</p></div><div><b>Ute</b><p>Das wurde Zeit.</p></div></div><footer>Impressum</footer></body>', "Neue Brücke\nDie neue Brücke wurde am Montag nach langer Bauzeit eröffnet und ist nun frei.\nViele Menschen kamen."),
    "unknown names": ('<body><div class="qx1"><a href=/1>One</a><a href=/2>Two</a><a href=/3>Three</a></div><div class="zz9"><h1>On walking</h1><p>Walking is the oldest way to get around, and for many it still is the best one there is.</p><p>It costs nothing.</p><ul><li>It keeps you fit.</li><li>It calms the mind.</li></ul></div><div class="vv4"><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>', "On walking\nWalking is the oldest way to get around, and for many it still is the best one there is.\nIt costs nothing.\nIt keeps you fit.\nIt calms the mind."),
    "main and aside": ('<body><header><a href=/>Site</a></header><main><h1>Report</h1><p>The report shows that prices rose by two percent over the last year.</p><aside><h4>Related</h4><a href=/r>Older report</a></aside><figure><img src=a><figcaption>Prices by month.</figcaption></figure><p>Wages rose too.</p></main><footer><p>About us. Contact.</p></footer></body>', "Report\nThe report shows that prices rose by two percent over the last year.\nPrices by month.\nWages rose too."),
    "data table": ('<body><nav><ul><li><a href=/>A</a><li><a href=/b>B</a></ul></nav><article><h1>Results</h1><p>The table gives the results of all three teams in the last season.</p><table><tr><th>Team<th>Points<tr><td>Red<td>12<tr><td>Blue<td>9</table><p>Red won.</p></article></body>', "Results\nThe table gives the results of all three teams in the last season.\nTeam\nPoints\nRed\n12\nBlue\n9\nRed won."),
    "newsletter inside": ('<body><article><h1>Garden</h1><p>Spring is the time to sow, and the soil should be warm and loose by then.</p><form><label>Your mail</label><input><button>Subscribe</button></form><div class="ad">Cheap tools here.</div><p>Water the beds in the evening.</p></article></body>', "Garden\nSpring is the time to sow, and the soil should be warm and loose by then.\nWater the beds in the evening."),
    "cookie": ('<body><div class="cookie-consent"><p>We use cookies to make this site better for you.</p><button>OK</button></div><div class="wrapper"><div class="menu"><a href=/1>Home</a> <a href=/2>Blog</a></div><div class="text"><p>There are few places as quiet as a library on a rainy afternoon in November.</p><p>Ours has two floors.</p></div></div><div class="footer">&copy; 2021 Library</div></body>', "There are few places as quiet as a library on a rainy afternoon in November.\nOurs has two floors."),
    "nested comments": ('<body><article><h1>Chess</h1><p>The match ended in a draw after sixty moves and more than five hours of play.</p><section class="comments"><article class="comment"><p>What a game, both played very well indeed.</p></article></section></article></body>', "Chess\nThe match ended in a draw after sixty moves and more than five hours of play."),
}


@pytest.fixture(scope="module")
def full_dom():
    return html_extract.train()


@pytest.mark.parametrize("name", sorted(HAND))
def test_html_extract_reads_other_layouts(full_dom, name):
    page, want = HAND[name]
    assert full_dom.extract([page]) == [want]


NAV = '<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 Bugle. All rights reserved.</footer>"
SAID = "the storm reached coast on monday evening and officials asked people to stay inside while rain was expected tomorrow for most of northern towns near rivers".split()


@pytest.mark.parametrize("size", [12, 15, 16, 17, 20, 30, 40, 41, 60])
@pytest.mark.parametrize("count", [1, 2, 3, 8])
def test_html_extract_short_and_bare_articles(full_dom, size, count):
    """Pages of a second layout code, with their exact texts: articles directly in the body, short ones, link lists and meaningless names."""
    r = random.Random(size * 10 + count)
    said = [" ".join(r.choice(SAID) for _ in range(size)).capitalize() + "." for _ in range(count)]
    wrapped, head = "".join(f"<p>{p}</p>" for p in said), "Storm reaches the coast"
    pages = {
        f"<html><body><h1>{head}</h1>{wrapped}</body></html>": [head, *said],
        f"<html><head><title>x</title></head><body>{NAV}<h1>{head}</h1>{wrapped}{FOOT}</body></html>": [head, *said],
        f"<html><body>{wrapped}</body></html>": said,
        f"<html><body>{NAV}<main><h1>{head}</h1>{wrapped}</main>{FOOT}</body></html>": [head, *said],
        f"<html><body><main><p>{said[0]}</p><ul><li><a href=/x>First source</a></li><li><a href=/y>Second source</a></li></ul>{wrapped[len(said[0]) + 7 :]}</main></body></html>": [said[0], "First source", "Second source", *said[1:]],
        f"<html><body>{NAV}<div class=c-a1><h2>Weather report</h2><ul><li>Wind</li><li>Rain</li><li>Snow</li></ul>{wrapped}</div>{FOOT}</body></html>": ["Weather report", "Wind", "Rain", "Snow", *said],
    }
    assert full_dom.extract(list(pages)) == ["\n".join(x) for x in pages.values()]


def test_html_extract_formulas(full_dom):
    page = "<article><h1>Energy at rest</h1><p>It says <math><mi>E</mi><mo>=</mo><msup><mi>m</mi><mn>2</mn></msup><annotation encoding=x>E=mc^2</annotation></math> for a body at rest, <svg viewBox=x><g><text>axis</text><svg><path d=z /></svg></g></svg>as everybody knows.</p><p>And so it has been said for a hundred years.</p></article>"
    assert full_dom.extract([page]) == ["Energy at rest\nIt says E=m2 for a body at rest, as everybody knows.\nAnd so it has been said for a hundred years."]


def test_html_extract_generalises(full_dom):
    right = total = 0
    for p in html_extract.labelled_pages(120, seed=1234):
        tree = html_extract.parse_html(p)
        for text, label, c in zip(tree.text, tree.label, full_dom.content([tree])[0]):
            if text is not None:
                total += 1
                right += (c > 0.5) == (label == html_extract.CONTENT)
    assert right / total > 0.97


def test_html_extract_long_pages(full_dom):
    """A page of many paragraphs, unclosed hidden spans, and one very long paragraph."""
    many = "".join(f"<p>Paragraph {i} by one.</p>" for i in range(5000))
    got = full_dom.extract([f"<nav><a href=/>Home</a></nav><article><h1>T</h1>{many}</article>", "<article><p>" + "word " * 200_000 + "end.</p></article>", "<article><p>One <span hidden>two</p><p>Three here.</p></article>"])
    assert got[0].count("\n") == 5000 and got[1].count(" ") == 200_000 and got[2] == "One\nThree here."


def test_sum_product_is_exact(dom):
    """Marginals of a small tree by enumeration of all states."""
    tree = html_extract.parse_html('<nav><a href=x>menu</a></nav><article><p>Some text here.</p></article>')
    n, nodes = len(tree.parent), [dom.node(f) for f in tree.feature]
    weight = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        w = np.log([0.98, 0.01, 0.01])[states[0]] + sum(x[0][s] for x, s in zip(nodes, states)) + sum(nodes[i][1][states[tree.parent[i]], states[i]] for i in range(1, n))
        for i, s in enumerate(states):
            weight[i, s] += np.exp(w)
    assert np.allclose(dom.content([tree])[0], weight[:, 1] / weight.sum(axis=1), atol=1e-6)


def test_html_extract_table(spark, dom):
    rows = [(1, "u", "<article><p>Hello there, this is text.</p></article>", "d", 1, 2), (None, None, None, "d", 1, 2), (1, "u", "<article><p>Hello there, this is text.</p></article>", "d", 1, 2)]
    got = html_extract.extract_text(spark.createDataFrame(rows, PAGES), dom).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in got) == Counter([(1, "Hello there, this is text.", 26)] * 2 + [(None, "", 0)])
    assert html_extract.extract_text(spark.createDataFrame([], PAGES), dom).count() == 0


def _code_length(text, train):
    """PPM, method C, without tables: bits of text after the training texts."""
    counts = defaultdict(Counter)
    for t in train:
        b = b"\0" * lang_id.ORDER + lang_id.text_bytes(t)
        for i in range(lang_id.ORDER, len(b)):
            for k in range(lang_id.ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1
    b, total = b"\0" * lang_id.ORDER + lang_id.text_bytes(text), 0.0
    for i in range(lang_id.ORDER, len(b)):
        for k in range(lang_id.ORDER, -2, -1):
            if k < 0:
                total += 8
                break
            c = counts.get(b[i - k : i])
            if not c:
                continue
            t, q = sum(c.values()), len(c)
            if c[b[i]]:
                total += np.log2((t + q) / c[b[i]])
                break
            del c[b[i]]
            total += np.log2((t + q) / q)
    return total


def test_code_lengths_are_exact(monkeypatch):
    train = {"aa": ["kalo miru tesa", "miru miru"], "bb": ["xyzzy plugh", "é è"]}
    model = lang_id.PpmModel(train)
    texts = ["kalo xyzzy", "", "Éé", "miru" * 50, "\x00\xff"]
    want = [[_code_length(t, train[k]) for k in ("aa", "bb")] for t in texts]
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5, atol=1e-3)
    monkeypatch.setattr(lang_id, "CHUNK", 8)
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5, atol=1e-3)


def test_language_id(docs, empty):
    rows = lang_id.language_id(docs).collect()
    truth = {i: lang for i, _, lang, _ in _texts()}
    assert len(rows) == len(_texts())
    by = {r.doc_id: r for r in rows}
    for i in (150, 151, 152, 153, 155):
        assert by[i].lang_pred == "und" and by[i].score == 0.0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id is not None and r.doc_id < 120]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert lang_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in lang_id.language_id(docs.where("lang is null")).collect()} == {"und"}


def test_quality(docs, empty, spark):
    r = random.Random(2)
    good = [(i, " ".join(r.choice(["kalo", "miru", "tesa", "vona", "rel"]) + str(r.randint(0, 1))[:0] + r.choice("abcdefghij") for _ in range(r.randint(5, 90))) + ".", 1) for i in range(300)]
    bad = [(1000 + i, " ".join(r.choice(["kalo###", "miru%%%", "$$$"]) for _ in range(r.randint(5, 90))), 0) for i in range(300)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in good + bad] + [(None, 1, 0), (5, None, 0), (77777, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(rows, labels).collect()
    held = [x for x in got if x.held_out]
    assert held and np.mean([x.predicted == (x.doc_id < 1000) for x in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    assert quality.score_quality(docs, labels).count() == len(_texts()) and quality.score_quality(empty, labels).count() == 0
    assert {x.score for x in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert {x.score for x in quality.score_quality(docs, labels.where("quality = 1")).collect()} <= {0.5, 1.0}
    assert quality.keep_quality(docs, labels).columns == docs.columns


def test_quality_prior_does_not_depend_on_the_sample(spark, monkeypatch):
    """Odds are those of all labels at any sample size; rows that repeat an id are learned from once."""
    r = random.Random(4)
    data = [(i, " ".join(r.choice(["alpha,", "beta", "gamma."]) for _ in range(30)) if i % 4 else "## || " * 20 + str(i)) for i in range(800)]
    docs = spark.createDataFrame(data + [data[1]] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(800)], "doc_id long, quality int")
    learn = ~held_out(F.col("doc_id"))
    kept = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 != 2]
    odds = np.log(sum(i % 4 > 0 for i in kept) / sum(i % 4 == 0 for i in kept))
    scores = []
    for rows in (50, 6_000):
        monkeypatch.setattr(quality, "TRAIN_ROWS", rows)
        model = quality.train(docs, labels, learn)
        assert np.isclose(model.prior, odds)
        scores.append(model.score(quality._statistics(pd.Series([t for _, t in data[:40]]))))
    assert np.abs(scores[0] - scores[1]).max() < 0.05


def test_quality_is_the_discriminant_of_its_statistics(spark):
    """The whole query against densities that are written out by hand, over statistics that are counted by hand."""
    r = random.Random(9)
    data = [(i, " ".join(r.choice(["One,", "two", "three.", "IV", "5"] if i % 3 else ["$$", "x|", "!!", "two"]) for _ in range(r.randint(5, 40)))) for i in range(300)]
    label = {i: int(i % 3 > 0) for i, _ in data}

    def stats(t):
        w, raw = t.split(), t.encode()
        count = lambda chars: sum(c in chars for c in raw)
        letters = max(1, len(raw) - count(b"\n") - count(b" \t\r\x0b\x0c"))
        of = {"symbol": (count(b"#$%&*+<=>@\\^_`~{}[]"), letters), "pipe": (count(b"|"), letters), "bang": (count(b"!"), letters), "upper": (sum(65 <= c <= 90 for c in raw), letters), "digit": (sum(48 <= c <= 57 for c in raw), letters), "repeat": (sum(a == b for a, b in zip(w, w[1:])), len(w)), "distinct": (len(set(w)), len(w)), "stop": (count(b".?"), len(w)), "comma": (count(b",;:"), len(w)), "line": (count(b"\n"), len(w))}
        out = []
        for name, typical in quality.SHARES:
            p = (of[name][0] + 20 * typical) / (of[name][1] + 20)
            out.append(np.log(p / (1 - p)) if name == "distinct" else np.log(p))
        return [*out, np.log((letters + 100) / (len(w) + 20))]

    x = np.array([stats(t) for _, t in data])
    fold = np.array([zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in data])
    y = np.array([label[i] for i, _ in data])
    own = [x[fold & (y == k)] for k in (0, 1)]
    n = np.array([len(g) for g in own])
    shift, scale = x[fold].mean(axis=0), x[fold].std(axis=0)
    scale[scale < 1e-9] = 1
    cov = [np.cov(((g - shift) / scale).T, bias=True) for g in own]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    log = []
    for k in (0, 1):
        c = 0.9 * cov[k] + 0.1 * pooled
        c = 0.98 * c + 0.02 * max(1e-3, np.trace(c) / len(c)) * np.eye(len(c))
        d = (x - shift) / scale - ((own[k] - shift) / scale).mean(axis=0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]) + np.log(n[k]))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    rows = quality.score_quality(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(list(label.items()), "doc_id long, quality int")).collect()
    assert len(rows) == 300 and all(np.isclose(x.score, want[x.doc_id], atol=1e-9) and x.predicted == (want[x.doc_id] >= 0.7) and x.held_out == (not fold[x.doc_id]) for x in rows)


def test_language_of_long_texts_is_learned(spark, monkeypatch):
    """A language that has long texts only, and copies of one text under one id, are learned within the bound."""
    monkeypatch.setattr(lang_id, "TRAIN_BYTES", 4_000)
    r = random.Random(8)
    make = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    short, long = ["kalo", "miru", "tesa"], ["xyzzy", "qwrt", "plugh"]
    data = [(i, make(short, 40), "aa") for i in range(200)] + [(1000 + i, make(long, 30_000), "bb") for i in range(3)] + [(None, make(["hmm", "oh"], 20), "cc")] * 500
    docs = spark.createDataFrame([*data, (5000, make(long, 20), None), (5001, make(["hmm", "oh"], 9), None)], "doc_id long, text string, lang string")
    model = lang_id.train(docs, F.lit(True))
    assert model.langs == ["aa", "bb", "cc"]
    got = {x.doc_id: x.lang_pred for x in lang_id.identify(docs, model).collect()}
    assert got[5000] == "bb" and got[5001] == "cc" and all(got[i] == "aa" for i in range(200)) and all(got[1000 + i] == "bb" for i in range(3))


def test_ranges_are_subdivided_to_the_end(spark):
    """No range of several keys stays too large, even where draws cannot split it."""
    none = np.zeros(0)
    assert np.array_equal(sharding.subdivided(3, 9, 4, none.astype(np.int64), none), [6])
    assert sharding.subdivided(-(1 << 63), (1 << 63) - 1, 2, none.astype(np.int64), none).tolist() == [0]
    assert sharding.subdivided(0, 1, 2, np.array([0, 0]), np.array([1.0, 1.0])).tolist() == [1]
    keys = [*range(50), *[10**17 + k for k in range(50)]]
    rows = spark.createDataFrame([(i, k, 1000 if k < 50 else 1) for i, k in enumerate(keys)], "doc_id long, key long, size long")
    plan = sharding.plan_shards(rows, 4)
    place = np.searchsorted(plan.splitters, np.array(keys), side="right")
    assert len(set(place[:50].tolist())) == 50
    load = Counter()
    for (_, k, size), p in zip(rows.collect(), place.tolist()):
        load[plan.shard[p]] += size
    assert max(load.values()) - min(load.values()) <= 1100


def test_mixing_flies_in_turns(spark, monkeypatch):
    """With small blocks leftovers fly several times; targets and bounds hold, and reruns agree."""
    monkeypatch.setattr(mixing, "BLOCK", 32)
    r = random.Random(6)
    data = [(i, "w " * r.randint(1, 60), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((x.doc_id, x.copies) for x in rows) == sorted((x.doc_id, x.copies) for x in again) and len(rows) == 3000
    taken, target = Counter(), {}
    for x in rows:
        taken[x.doc_id % 3] += x.taken
        target[x.doc_id % 3] = x.target
        assert 0 <= x.copies <= 2 and x.taken == x.size * x.copies
    assert all(abs(taken[k] - target[k]) <= 60 for k in target)


def test_hot_rows_without_an_id(spark):
    """Thousands of equal rows of one null id, and of one repeated id, beside a few others."""
    line = "one two three four five six seven"
    rows = [(None, line, "s1")] * 3000 + [(9, line, "s2")] * 2000 + [(1, "other words stand here alone today", "s1"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = exact_dedup.exact_dedup(docs).groupBy("doc_id", "keep_id", "group_size").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.n) for r in got) == Counter([(None, 9, 5000, 0, 3000), (9, 9, 5000, 1, 2000), (1, 1, 1, 1, 1), (None, None, 1, 1, 1)])
    got = simhash.simhash_groups(docs).groupBy("doc_id", "component_id").count().collect()
    assert Counter((r.doc_id, r.component_id, r["count"]) for r in got) == Counter([(None, 9, 3000), (9, 9, 2000), (1, 1, 1), (None, None, 1)])
    items = spark.createDataFrame([(4, line)], "item_id long, text string")
    assert Counter(r.doc_id for r in decontamination.contaminated(docs, items).collect()) == Counter({None: 3000, 9: 2000})
    assert Counter(r.text for r in decontamination.decontaminate(docs, items).collect()) == Counter(["other words stand here alone today", None])
    assert Counter(r.n_removed for r in line_dedup.line_dedup(docs, min_sites=2).collect()) == Counter({1: 5000, 0: 2})
    assert Counter((r.doc_id, r.text) for r in simhash.near_dedup(docs).collect()) == Counter([(9, line), (1, "other words stand here alone today"), (None, None)])
    placed = sharding.shard_table(docs, 4).collect()
    assert len(placed) == 5002 and all(sorted(r.slot for r in placed if r.shard == k) == list(range(sum(r.shard == k for r in placed))) for k in range(4))
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == 5002 and all(0 <= r.copies <= 2 for r in mixed)


def test_session_settings_come_back(spark):
    from verdictflow.llm._shared import cut, small_batches, uncut

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark):
        assert spark.conf.get(name) != before
    assert spark.conf.get(name) == before
    kept = cut(spark.range(5))
    gone = cut(kept.selectExpr("id + 1 AS id"))
    uncut(gone)
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)checkpoint"):
        gone.count()


def test_discriminant_is_the_gaussian_log_ratio():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(0, 1, (200, 3)), r.normal(1, 2, (300, 3))])
    y = np.r_[np.zeros(200), np.ones(300)]
    m = quality.QuadraticDiscriminant(x, y)
    z = (x - m.shift) / m.scale
    log = []
    for k in (0, 1):
        s = np.linalg.inv(m.factor[k].T @ m.factor[k])
        d = z - m.mean[k]
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) + np.linalg.slogdet(s)[1]))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-(log[1] - log[0] + np.log(1.5)))), atol=1e-9)
