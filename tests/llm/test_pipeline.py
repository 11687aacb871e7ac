"""The pipeline's stages and queries, on tables laid out as the driver's."""

import os
import zlib
from collections import Counter, defaultdict

import pytest
import regex

import corpus_pipeline
from verdictflow.llm import decontamination, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_pipeline_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids, seen = {r.doc_id for r in docs.select("doc_id").collect()}, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept < ids and len(kept) > 0.5 * len(ids), name
        ids, seen = kept, out
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {r.doc_id for r in rows} <= ids and {"shard", "slot"} <= set(out.columns)


def _shingles(words, k=5):
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near_survivors(rows):
    """Ids that stay: of each chain of texts of similarity 0.8, by all pairs that share a shingle, the smallest."""
    sets = {i: _shingles((t or "").lower().split()) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    having = defaultdict(list)
    for i, s in sets.items():
        for x in s or {()}:
            having[x].append(i)
    for i, s in sets.items():
        shared = Counter(j for x in s or {()} for j in having[x])
        for j, n in shared.items():
            if n >= 0.8 * (max(1, len(s)) + max(1, len(sets[j])) - n) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in sets if root(i) == i}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before has kept, against a plain form of its rule."""
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    docs, kept, stages = spark.read.parquet(f"{SF}/documents.parquet"), [], dict(corpus_pipeline.STAGES)

    def step(name):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, out.collect()

    scored = quality.score_quality(docs, labels).where("predicted = 1").collect()
    docs, kept = step("quality")
    assert Counter(r.doc_id for r in kept) == Counter(r.doc_id for r in scored)

    want = near_survivors([(r.doc_id, r.text) for r in kept])
    docs, kept = step("near_dedup")
    assert Counter(r.doc_id for r in kept) == Counter(want)

    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    items = [(min(5, len(w)), _shingles(w)) for w in (words(r.text) for r in benchmark.collect()) if w]
    held = lambda t: any(len(s & _shingles(words(t), k)) >= decontamination.CONTAINMENT * len(s) - 1e-9 for k, s in items)
    want = {r.doc_id for r in kept if not held(r.text)}
    assert len(want) < len(kept)
    docs, kept = step("decontamination")
    assert {r.doc_id for r in kept} == want

    size = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in kept:
        per[r.source] += size(r.text)
    order = sorted(per, key=lambda x: (x is None, x or ""))
    weight, cap, total = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}, set(), 1.5 * sum(per.values())
    while True:  # shares above twice a source are cut, and the rest is dealt out anew
        level = (total - sum(2 * per[k] for k in cap)) / max(1e-9, sum(weight[k] for k in order if k not in cap))
        more = {k for k in order if k not in cap and weight[k] * level > 2 * per[k]}
        if not more:
            break
        cap |= more
    target = {k: 2 * per[k] if k in cap else weight[k] * level for k in order}
    longest, before = max(size(r.text) for r in kept), {r.doc_id: r for r in kept}
    docs, mixed = step("mixing")
    taken, times = Counter(), Counter(r.doc_id for r in mixed)
    for r in mixed:
        taken[r.source] += size(r.text)
        assert r == before[r.doc_id]
    assert max(times.values()) <= 2 and all(abs(taken[k] - target[k]) <= longest for k in order)

    _, placed = step("sharding")
    assert Counter(r.doc_id for r in placed) == times
    slots, of_text = defaultdict(list), {}
    for r in placed:
        slots[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and of_text.setdefault(r.text, r.shard) == r.shard
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_contract_columns(spark):
    if not os.path.isdir(SF):
        pytest.skip("the driver's tables are not here")
    want = {"op1_language_id": "doc_id held_out lang_pred score", "op2_quality": "doc_id held_out score predicted", "op4_mixing": "doc_id size source_size target taken", "op5_simhash": "doc_id fingerprint component_id", "op6_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op7_warc": "page_id payload_bytes payload_digest record_type refers_to", "op8_html_extract": "page_id url text n_chars", "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256"}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns == columns.split()
