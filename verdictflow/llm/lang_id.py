"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order byte context tree with escape probabilities (method C: a context
with total count T and q distinct symbols gives a seen symbol n / (T + q) and escapes with
q / (T + q) to the next shorter context; below order 0 all 256 bytes are alike). Statistics are
frozen after training, so the code length of a byte depends on its last ORDER bytes alone. The trees are
compiled into one table of grams for all languages: scoring a byte is one table look-up, and only
unseen grams descend to shorter contexts. The language with the shortest code wins.

Training takes a bounded sample: about TRAIN_BYTES bytes of each language, from texts chosen by a hash of id
and text, one text at least; of a text longer than that, training reads TRAIN_BYTES characters. Texts are
lower-cased; whole texts of any length are scored.

Defined results: null text or text without a letter is `und` with score 0; so is all text if nothing
could be learned; ties go to the language that sorts first; rows with null lang are not learned from, and
rows that repeat id and text are learned from once; extra columns are ignored; repeated rows are each scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import held_out

ORDER = 4
TRAIN_BYTES = 400_000
CHUNK = 1 << 19
UND = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text or ""))


def text_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class GramIndex:
    """Positions of packed grams: two hashed tables, and a sorted rest for what collides in both."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, grams: np.ndarray):
        self.bits = max(8, int(len(grams)).bit_length() + 2)
        self.tables, rest = [], np.arange(len(grams))
        for m in self.MULTIPLIERS:
            slot = self._slot(grams[rest], m)
            first = np.unique(slot, return_index=True)[1]
            keys, at = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF)), np.full(1 << self.bits, -1, np.int32)
            keys[slot[first]], at[slot[first]] = grams[rest[first]], rest[first]
            self.tables.append((m, keys, at))
            rest = np.delete(rest, first)
        order = rest[np.argsort(grams[rest])]
        self.rest_keys, self.rest_at = grams[order], order

    def _slot(self, grams: np.ndarray, multiplier: int) -> np.ndarray:
        return (grams * np.uint64(multiplier)) >> np.uint64(64 - self.bits)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """The position of each gram, or -1."""
        m, keys, at = self.tables[0]
        slot = self._slot(grams, m)
        out = np.where(keys[slot] == grams, at[slot], -1)
        left = np.flatnonzero(out < 0)
        if len(left):
            m, keys, at = self.tables[1]
            slot = self._slot(grams[left], m)
            out[left] = np.where(keys[slot] == grams[left], at[slot], -1)
            left = left[out[left] < 0]
        if len(left) and len(self.rest_keys):
            i = np.minimum(np.searchsorted(self.rest_keys, grams[left]), len(self.rest_keys) - 1)
            out[left] = np.where(self.rest_keys[i] == grams[left], self.rest_at[i], -1)
        return out


def _packed(data: np.ndarray, length: int) -> np.ndarray:
    """For each byte after the first ORDER, it and those before it, `length` bytes in all, as one number."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint64)
    for back in range(length - 1, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - back : ORDER - back + n]
    return out


class PpmModel:
    """Frozen PPM statistics of all languages, compiled for look-up."""

    def __init__(self, texts: dict[str, list[str]]):
        self.langs = sorted(k for k, v in texts.items() if any(v))
        self.levels: list[tuple] = []
        n = len(self.langs)
        pad = b"\0" * ORDER
        data = [np.concatenate([np.frombuffer(pad + text_bytes(t), np.uint8) for t in texts[k] if t]) for k in self.langs]
        real = [np.concatenate([np.r_[np.zeros(ORDER, bool), np.ones(len(text_bytes(t)), bool)] for t in texts[k] if t]) for k in self.langs]
        lower = None
        for order in range(ORDER + 1):
            own = [np.unique(_packed(d, order + 1)[r[ORDER:]], return_counts=True) for d, r in zip(data, real)]
            grams = np.unique(np.concatenate([g for g, _ in own])) if own else np.empty(0, np.uint64)
            contexts = np.unique(grams >> np.uint64(8))
            bits, escape = np.zeros((len(grams), n)), np.zeros((len(contexts), n))
            below = np.full((len(grams), n), 8.0) if lower is None else lower[1][np.searchsorted(lower[0], grams & np.uint64((1 << 8 * order) - 1))]
            for i, (g, c) in enumerate(own):
                at = np.searchsorted(contexts, g >> np.uint64(8))
                total, distinct = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escape[seen, i] = np.log2((total[seen] + distinct[seen]) / distinct[seen])
                bits[:, i] = below[:, i] + escape[np.searchsorted(contexts, grams >> np.uint64(8)), i]
                bits[np.searchsorted(grams, g), i] = np.log2((total[at] + distinct[at]) / c)
            self.levels.append((GramIndex(grams), bits.astype(np.float32), GramIndex(contexts), escape.astype(np.float32)))
            lower = grams, bits

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each whole text under each language's tree; work is done in chunks of CHUNK bytes."""
        total = np.zeros((len(texts), len(self.langs)))
        held, owner, size = [], [], 0
        for i, t in enumerate(texts):
            b = text_bytes(t)
            for s in range(0, len(b), CHUNK):
                piece = (b"\0" * ORDER + b[:CHUNK]) if s == 0 else b[s - ORDER : s + CHUNK]
                held.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= CHUNK:
                    self._score(held, owner, total)
                    held, owner, size = [], [], 0
        if held:
            self._score(held, owner, total)
        return total

    def _score(self, pieces: list[bytes], owner: list[int], total: np.ndarray) -> None:
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(p) for p in pieces])
        starts = np.cumsum(sizes) - sizes
        real = np.ones(len(data), bool)
        real[(starts[:, None] + np.arange(ORDER)).ravel()] = False
        grams = _packed(data, ORDER + 1)[real[ORDER:]]
        doc = np.repeat(np.arange(len(pieces)), sizes - ORDER)
        own = np.zeros((len(pieces), len(self.langs)))
        for order in range(ORDER, -1, -1):
            index, bits, contexts, escape = self.levels[order]
            at = index.find(grams)
            hit = at >= 0
            self._add(own, doc[hit], bits[at[hit]])
            if hit.all():
                grams = grams[:0]
                break
            grams, doc = grams[~hit], doc[~hit]
            at = contexts.find(grams >> np.uint64(8))
            self._add(own, doc[at >= 0], escape[at[at >= 0]])
            grams = grams & np.uint64((1 << 8 * order) - 1)
        self._add(own, doc[: len(grams)], np.full((len(grams), len(self.langs)), 8.0))
        np.add.at(total, np.array(owner), own)

    @staticmethod
    def _add(own: np.ndarray, doc: np.ndarray, bits: np.ndarray) -> None:
        for i in range(own.shape[1]):
            own[:, i] += np.bincount(doc, bits[:, i], len(own))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = np.array([has_letter(t) for t in texts], bool)
        langs, score = [UND] * len(texts), np.zeros(len(texts))
        if self.langs and letters.any():
            at = np.flatnonzero(letters)
            bits = self.code_lengths([texts[i] for i in at])
            best = bits.argmin(axis=1)
            odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0))
            score[at] = 1 / odds.sum(axis=1)
            for i, b in zip(at, best):
                langs[i] = self.langs[b]
        return langs, score


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel:
    """Learn from rows where `learn` holds; only the bounded sample reaches the driver."""
    text = F.col(text_col)
    size = F.least(F.octet_length(text), F.lit(TRAIN_BYTES))
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang_col).alias("lang"), text.alias("text"), size.alias("n"), F.xxhash64(id_col, text_col, F.lit("ppm")).alias("h"))
    totals = {r["lang"]: r for r in rows.groupBy("lang").agg(F.sum("n").alias("n"), F.min("h").alias("first")).collect()}
    if not totals:
        return PpmModel({})
    each = lambda value: F.try_element_at(F.create_map(*[x for k, v in sorted(totals.items()) for x in (F.lit(k), F.lit(value(v)))]), F.col("lang"))
    chance = each(lambda v: min(1.0, 1.3 * TRAIN_BYTES / v["n"]))
    drawn = rows.where((F.pmod("h", F.lit(1 << 40)) < chance * float(1 << 40)) | (F.col("h") == each(lambda v: v["first"])))
    # Equal rows are one before they leave their task, so copies cannot swell the sample.
    drawn = drawn.select("lang", "h", "n", F.substring("text", 1, TRAIN_BYTES).alias("text")).dropDuplicates(["lang", "h"])
    texts: dict[str, list[str]] = {}
    used: dict[str, int] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"], r["text"])):
        if used.get(r["lang"], 0) < TRAIN_BYTES:
            used[r["lang"]] = used.get(r["lang"], 0) + r["n"]
            texts.setdefault(r["lang"], []).append(r["text"])
    return PpmModel(texts)


def identify(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, score = model.predict(b.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": score})

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predict(text_col).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the fold that is not held out, then identify every row."""
    return identify(docs, train(docs, ~held_out(F.col(id_col)), id_col, text_col, lang_col), id_col, text_col)
