"""Token files, ranked search and the Merkle manifest against brute force, on rows with nulls, ties, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_operators import SCHEMA, _texts
from verdictflow.llm import merkle, search, token_files
from verdictflow.llm._shared import delete_path, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
EXTRA = [(160, "", "bb", "s9"), (161, "<|endoftext|> inside <|endoftext|>", "bb", None), (-4, "before all  others", None, "s9"), (None, None, None, None), (162, "naïve ÀÉ naïve 東京 Kalo KALO\x00kalo", "zz", "é")]


def _rows():
    return [(*r, None if i % 11 == 0 else len(r[1] or "")) for i, r in enumerate([*_texts(), *EXTRA])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, n, 0.5, "k", 1, "f", "w", 3, 4) for i, t, lang, s, n in _rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# Token files


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*" \t\n\r\x0b\x1c\x85\xa0ab'sé東1²,.!<|>　", "don't", "  x", "<|endoftext|>"]), max_size=40).map("".join))
def test_pieces_encode_as_the_whole(text):
    assert np.frombuffer(ENCODER([text])[0], "<u2").tolist() == ENCODER.library.encode(text, add_special_tokens=False).ids


ENCODER = token_files.Encoder(TOKENIZER)


def test_pieces_are_forgotten_and_encoded_again(monkeypatch):
    monkeypatch.setattr(token_files, "PIECES_KEPT", 20)
    monkeypatch.setattr(token_files, "WORDS_KEPT", 20)
    own, r = token_files.Encoder(TOKENIZER), random.Random(2)
    for _ in range(60):
        texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 120 if r.random() < 0.1 else 4) for _ in range(9)) for _ in range(3)]
        assert [np.frombuffer(x, own.type).tolist() for x in own(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.known) <= 20 + 9 and len(own.words) <= 20 + 9


def test_other_vocabularies_are_encoded_whole():
    other = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.by_piece and np.frombuffer(other(["A plain Text"])[0], "<u2").tolist() == other.library.encode("A plain Text", add_special_tokens=False).ids


def test_token_files(spark, docs, empty, library):
    encoded = [(i is not None, i or 0, i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in _rows()]
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, path, TOKENIZER, sequence=64)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [x[2] for x in sorted(encoded, key=lambda x: x[:2])]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for *_, i, ids in encoded)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # Every sequence has the same length, and unmasked ids are the documents' in their order.
    flat, files = [], sorted(spark.read.parquet(f"{path}/manifest").collect(), key=lambda r: r.part)
    for f in files:
        assert f.start == len(flat)
        opened = token_files.TokenFile(f"{path}/files/{f.file}")
        own = [opened[i] for i in range(len(opened))]
        assert all(len(ids) == len(mask) == 64 for ids, mask in own) and all(all(mask.to_pylist()) for _, mask in own[:-1])
        flat += [int(x) for ids, mask in own for x in ids[np.asarray(mask)]]
        ids = opened[0][0]
        del own, ids
        with pytest.raises(IndexError):
            opened[len(opened)]
    by_id = defaultdict(list)
    for *_, i, ids in encoded:
        by_id[i].append(ids)
    for r in got:
        own = flat[r.start : r.start + r.n_tokens]
        by_id[r.doc_id].remove(own)
    assert len(flat) == at
    none = scratch_path(spark, "tokens")
    token_files.write_token_files(empty, none, TOKENIZER)
    assert token_files.read_documents(spark, none).count() == 0
    delete_path(spark, path)


def test_a_view_is_not_copied(tmp_path):
    with open(tmp_path / "x.arrow", "wb") as sink:
        w = token_files.SequenceWriter(sink, 8, np.dtype("<u4"))
        w.add(5, np.arange(20, dtype="<u4").tobytes())
        w.add(6, np.arange(100, 108, dtype="<u4").tobytes())
        w.close()
    f = token_files.TokenFile(str(tmp_path / "x.arrow"))
    ids, mask = f[1]
    assert ids.tolist() == list(range(8, 16)) and not ids.flags.owndata and not ids.flags.writeable and all(mask.to_pylist())
    assert f[3][1].to_pylist() == [True] * 4 + [False] * 4
    assert [(d, s, n, np.concatenate(list(p)).tolist()) for d, s, n, p in f.documents()] == [(5, 0, 20, list(range(20))), (6, 20, 8, list(range(100, 108)))]


def test_documents_longer_than_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 2)
    sizes, r = [1, 50, 3, 8, 16, 1, 200], random.Random(1)
    ids = [np.array([r.randrange(2**32) for _ in range(n)], "<u4") for n in sizes]
    with open(tmp_path / "x.arrow", "wb") as sink:
        w = token_files.SequenceWriter(sink, 8, np.dtype("<u4"))
        for i, x in enumerate(ids):
            w.add(i, x.tobytes())
        w.close()
    f = token_files.TokenFile(str(tmp_path / "x.arrow"))
    got = [(d, np.concatenate(list(p)).tolist()) for d, _, _, p in f.documents()]
    assert got == [(i, x.tolist()) for i, x in enumerate(ids)] and len(f) == -(-sum(sizes) // 8)


def test_files_of_lost_attempts_are_deleted(spark, docs):
    import os

    path = scratch_path(spark, "tokens")
    os.makedirs(f"{path}/files")
    open(f"{path}/files/part-00000-left.arrow", "wb").close()
    token_files.write_token_files(docs, path, TOKENIZER)
    assert set(os.listdir(f"{path}/files")) == {r.file for r in spark.read.parquet(f"{path}/manifest").collect()}


# Search


def _terms(text):
    return re.findall(search.TERM, (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _ranked(rows, queries, k):
    counts = [(i, Counter(_terms(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for q, t in queries:
        asked[q] |= set(_terms(t))
    out = []
    for q, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 10 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return out


QUERIES = [(1, "Kalo miru"), (2, "xyzzy plugh qwrt shared LINE"), (3, None), (4, ""), (5, "absent words"), (6, "naïve 東京"), (7, "y z"), (7, "x kalon"), (None, "tesa"), (8, "kalo kalo kalo"), (9, "before all others vona")]


@pytest.mark.parametrize("segment,block", [(10**6, 100), (200, 1), (1500, 3)])
def test_search(spark, docs, empty, monkeypatch, segment, block):
    monkeypatch.setattr(search, "BLOCK_QUERIES", block)
    asked = spark.createDataFrame([(i, t, "x") for i, t in QUERIES], "item_id long, text string, doc_id string")
    got = search.ranked(docs, asked, 10, segment).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _ranked([(r[0], r[1]) for r in _rows()], QUERIES, 10)))
    assert search.ranked(empty, asked).count() == 0 and search.ranked(docs, asked.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 40), st.integers(0, 6), min_size=1), max_size=7), st.integers(1, 5))
def test_merge_finds_the_best(lists, k):
    packed = [(array("i", sorted(x)), array("q", [x[d] for d in sorted(x)]), max(x.values())) for x in lists]
    total = Counter()
    for x in lists:
        total.update(x)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert search.best_documents(packed, k) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**40))))
def test_packing(values):
    data, ends = search.pack(np.array(values, np.int64))
    assert search.unpack(data.tobytes()).tolist() == values and len(ends) == len(values)


def test_segments_of_an_index():
    r, segment = random.Random(5), search._Segment()
    texts = {i: " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for i in r.sample(range(1000), 60)}
    for i, t in texts.items():
        segment.add(i, t.encode())
    rows = [x for b in segment.rows(3) for x in b.to_pylist()]
    ids = rows[0]["ids"]
    assert ids == sorted(texts) and rows[0]["lengths"] == [len(texts[i].split()) for i in ids]
    for x in rows[1:]:
        flat = search.unpack(x["postings"]).reshape(-1, 2)
        assert {ids[d]: n for d, n in zip(np.cumsum(flat[:, 0]), flat[:, 1])} == {i: t.split().count(x["term"]) for i, t in texts.items() if x["term"] in t.split()}


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("Word, other; wörd " * 500).encode()
    whole = search.term_counts(text)
    monkeypatch.setattr(search, "PIECE", 7)
    assert search.term_counts(text) == whole == Counter({b"word": 500, b"other": 500, "wörd".encode(): 500})


# The Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _audit(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: _h(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    groups = {g: sorted(groups[g], key=lambda x: x[:3]) for g in names}
    trees = {g: _levels([x[2] for x in groups[g]]) for g in names}
    top = _levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for p, (*_, own, r) in enumerate(groups[g]):
            path = []
            for tree, at in ((trees[g], p), (top, k)):
                for level in tree[:-1]:
                    path.append((level[at ^ 1] if at ^ 1 < len(level) else None, at & 1))
                    at >>= 1
            node = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else own
            for sibling, second in path:
                node = _h(node) if sibling is None else _h(sibling, node) if second else _h(node, sibling)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], _h(*[s for s, _ in path if s]), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("levels", [10, 1, 3])
def test_merkle(docs, empty, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = Counter(map(tuple, merkle.audit(docs).collect()))
    assert got == _audit(_rows())
    assert not all(x[-1] for x in got) and any(x[-1] for x in got)
    assert merkle.audit(empty).count() == 0


def test_merkle_of_hot_equal_rows(spark):
    """Equal rows are spread over many tasks, and each has its own place."""
    docs = spark.range(0, 3000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("aa").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("same").alias("text"))
    slim = docs.select("doc_id", F.lit("1aa").alias("g"), F.lit("x").alias("hash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would be put together
    numbered = merkle.number(slim, ["doc_id", "hash"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.pos for r in numbered.select("pos").collect()) == list(range(3000))
    assert numbered.select(F.spark_partition_id()).distinct().count() > 1
    assert Counter(map(tuple, merkle.audit(docs).collect())) == _audit([(7, "same", "aa", "s", 1)] * 3000)


def test_merkle_of_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    for n in (1, 4, 5, 17):
        rows = [(i, f"t{i}", "aa" if i % 3 else None, "s", i) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert Counter(map(tuple, merkle.audit(docs).collect())) == _audit(rows), n
