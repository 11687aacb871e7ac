"""Token ids in Arrow files of equal-length sequences.

A text's ids come from a tokenizer file of the tokenizers library, with an end id after each document. Documents are
dealt out by ascending doc_id to parts (as many as the session's shuffle partitions); each part is one Arrow IPC file, whose record
batches hold `ids` (of two bytes where the vocabulary allows it, else of four) and `mask` (bits) as fixed-size lists
of SEQUENCE values: one document follows the other without a gap, and only the last sequence of a file is padded
(mask 0). `docs` lists the documents that begin in a sequence: doc_id, `at`, the place of the first id in the
sequence, and `n_tokens`. Lists of fixed size have no offsets, so the i-th sequence of a memory-mapped file is a view
of its bytes: TokenFile gives sequences, masks and documents that way.

Tasks write through pyarrow.fs (local and shared mounts, HDFS, S3, GCS; other stores are an error), each attempt to
a file name of its own. What tasks report is written as the table `manifest`, one row for each file: part, file,
n_docs, n_tokens and start, the ids of all parts before it. A file that the manifest does not name is what a lost or
repeated attempt left; it is deleted, and no reader opens it.

Defined results: null text is empty and has the end id alone; null ids come first; rows of one id are ordered by
the hash of their text; equal rows are documents of their own; extra columns are ignored; an empty table gives a
manifest without rows. Whole texts are encoded, also where they hold the name of a special token, which the library
reads as that token.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, delete_path, frugal, small_batches

SEQUENCE = 2048
#: Sequences of a record batch.
BATCH_SEQUENCES = 512
END_ID = 0
#: Encoded pieces and words that a worker remembers, about 300 MB; with more than that it starts afresh at the next text.
PIECES_KEPT, WORDS_KEPT = 1_000_000, 500_000
#: Fixed values of byte-level vocabularies: how text falls into words, and the characters by which they write bytes.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}
TOKEN_ID = attrgetter("id")
#: Letters and digits below this are such in any version of Unicode that the library may have.
SETTLED = regex.compile(r"[\x00-\u024F]*")
DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("n_tokens", pa.int64())]))
WRITTEN = "part int, file string, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Batches of texts to bytes of little-endian ids, of two bytes where the vocabulary allows it, else of four.

    A byte-level vocabulary never joins a space that a visible character follows to what is before it, so such a
    text is cut there, and each distinct piece is encoded once, as long as it is remembered. The words of a piece of
    Latin letters go to the library's model directly, other pieces to the whole library. Texts for other vocabularies,
    and texts in which an added token occurs, are encoded whole.
    """

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.type = np.dtype("<u2" if max(self.library.get_vocab().values()) < 1 << 16 else "<u4")
        self.model = self.library.model
        self.known = _Known(self._piece)
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            shown = (word if word.isascii() else word.encode().decode("latin-1")).replace(" ", chr(BYTES[32]))
            if not shown.isprintable():
                shown = shown.translate(BYTES)
            ids = self.words[word] = array(self.type.char, map(TOKEN_ID, self.model.tokenize(shown))).tobytes()
        return ids

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece; a space and one word, or these and a punctuation mark, are told apart without a pattern."""
        if not piece.isascii() and not SETTLED.fullmatch(piece):
            return self._encode([piece])[0]
        if piece[1:].isalpha() and piece[0] == " ":
            return self._word(piece)
        if piece[1:-1].isalpha() and piece[0] == " " and piece[-1] in ",.;:!?":
            return self._word(piece[:-1]) + self._word(piece[-1])
        return b"".join([self._word(w) for w in WORDS.findall(piece)])

    @staticmethod
    def _pieces(text: str) -> tuple[str, list[str]]:
        """The text, cut before each space that a visible character follows: the first piece, and the others without that space."""
        if text.endswith(" ") or re.search(r" \s", text):
            first, *rest = re.split(r" (?=\S)", text)
        else:
            first, *rest = text.split(" ")
        return first, rest

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if not self.by_piece or any(x in t for x in self.added)]
        out = dict(zip(whole, self._encode([texts[i] for i in whole])))
        for i, text in enumerate(texts):
            if i not in out:
                if len(self.words) > WORDS_KEPT:
                    self.words.clear()
                if len(self.known) > PIECES_KEPT:
                    self.known.clear()
                first, rest = self._pieces(text)
                out[i] = self._piece(first) + b"".join(map(self.known.__getitem__, rest))
        return [out[i] for i in range(len(texts))]


class _Known(dict):
    """The ids of pieces after a space, worked out when a piece is first asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(f" {piece}")
        if len(piece) < 100:
            self[piece] = ids
        return ids


@cache
def _encoder(tokenizer: str) -> Encoder:
    """One for each Python worker, with what it remembers from one task to the next."""
    return Encoder(tokenizer)


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path that Spark can name, and the path there."""
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def schema(sequence: int, kind: np.dtype) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(kind), False), sequence)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), sequence)), ("docs", DOCS)])


class SequenceWriter:
    """Packs documents into sequences; a full batch is written at once, so memory holds one batch and one document."""

    def __init__(self, sink, sequence: int, kind: np.dtype):
        self.sequence, self.type, self.schema = sequence, kind, schema(sequence, kind)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.buffer = bytearray()
        self.begun: list[tuple[int, int | None, int]] = []  # place in the buffer, doc_id, ids
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        width = self.type.itemsize
        self.begun.append((len(self.buffer) // width, doc_id, len(ids) // width))
        self.buffer += ids
        self.n_docs += 1
        self.n_tokens += len(ids) // width
        while len(self.buffer) >= width * self.sequence * BATCH_SEQUENCES:
            self._flush(self.sequence * BATCH_SEQUENCES)

    def _flush(self, n: int) -> None:
        """Write the first n ids; the last sequence is padded if n does not fill it."""
        rows = -(-n // self.sequence)
        ids = np.zeros(rows * self.sequence, self.type)
        ids[:n] = np.frombuffer(self.buffer, self.type, n)
        mask = np.arange(rows * self.sequence) < n
        here = [x for x in self.begun if x[0] < n]
        offsets = np.searchsorted([x[0] for x in here], np.arange(rows + 1) * self.sequence)
        entries = pa.StructArray.from_arrays([pa.array([x[1] for x in here], pa.int64()), pa.array([x[0] % self.sequence for x in here], pa.int32()), pa.array([x[2] for x in here], pa.int64())], fields=list(DOCS.value_type))
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(a), type=t.type) for a, t in zip((ids, mask), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries, type=DOCS)], schema=self.schema))
        del self.buffer[: self.type.itemsize * n]
        self.begun = [(at - n, *rest) for at, *rest in self.begun[len(here) :]]

    def close(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer) // self.type.itemsize)
        self.out.close()


class TokenFile:
    """Random access to a file: sequences, masks and documents are views of its memory map where the file is local."""

    def __init__(self, path: str):
        fs, at = _place(path)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * BATCH_SEQUENCES + self.file.get_batch(n - 1).num_rows if n else 0

    def _ids(self, k: int) -> np.ndarray:
        return self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of the i-th sequence, as a NumPy view, and its mask, as an Arrow view of bits."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, at = i // BATCH_SEQUENCES, i % BATCH_SEQUENCES * self.sequence
        return self._ids(k)[at : at + self.sequence], self.file.get_batch(k).column("mask").flatten().slice(at, self.sequence)

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[np.ndarray]]]:
        """(doc_id, start, n_tokens, pieces) of each document; its ids are views of one batch each, to be taken before the next document."""
        for k in range(self.file.num_record_batches):
            batch = self.file.get_batch(k)
            docs = batch.column("docs")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(docs.offsets.to_numpy()))
            entries = docs.flatten()
            for row, doc_id, at, n in zip(rows.tolist(), *[entries.field(i).to_pylist() for i in range(3)]):
                start = (k * BATCH_SEQUENCES + row) * self.sequence + at
                yield doc_id, start, n, self.span(start, n)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """n ids from the start-th on, batch by batch."""
        size = BATCH_SEQUENCES * self.sequence
        while n > 0:
            ids = self._ids(start // size)[start % size : start % size + n]
            yield ids
            start, n = start + len(ids), n - len(ids)

    def close(self) -> None:
        self.source.close()


def _write(tokenizer: str, folder: str, sequence: int, end_id: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, encode = None, _encoder(tokenizer)
        end = np.array([end_id], encode.type).tobytes()
        part, file = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.arrow"
        fs, at = _place(folder)
        sink = None
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                if writer is None:
                    sink = fs.open_output_stream(f"{at}/{file}")
                    writer = SequenceWriter(sink, sequence, encode.type)
                writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs to the folder `path`: files of token ids and their manifest."""
    spark = docs.sparkSession
    fs, at = _place(path)
    fs.create_dir(f"{at}/files")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    order = ["doc_id", "_hash", "_place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(spark):
        written = cut(dealt.mapInArrow(_write(tokenizer, f"{path}/files", sequence, end_id), WRITTEN))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    manifest = written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    named = {r["file"] for r in written.select("file").toLocalIterator()}
    for left in fs.get_file_info(pa.fs.FileSelector(f"{at}/files")):
        if left.base_name not in named:
            fs.delete_file(left.path)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4
        names = [x.split()[0] for x in READ.split(", ")]

        def flushed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, types)], names=names)

        for b in batches:
            for name, offset in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file, rows = TokenFile(f"{folder}/{name}"), []
                for doc_id, start, n, pieces in file.documents():
                    crc = 0
                    for ids in pieces:
                        crc = zlib.crc32(ids.astype("<u4"), crc)
                    rows.append((doc_id, offset + start, n, crc))
                    if len(rows) >= 10_000:
                        yield flushed(rows)
                        rows = []
                yield flushed(rows)
                file.close()

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of the files: doc_id, start (among the ids of all files), n_tokens, ids_crc32."""
    manifest = spark.read.parquet(f"{path}/manifest")
    files = max(1, manifest.count())
    return manifest.select("file", "start").repartition(files, "file").mapInArrow(_read(f"{path}/files"), READ)


def round_trip(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """Write the files, read them back and delete them."""
    write_token_files(docs, path, tokenizer)
    out = cut(read_documents(docs.sparkSession, path))
    delete_path(docs.sparkSession, path)
    return out
