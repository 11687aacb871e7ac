"""WARC archives: one request, response and metadata record for each page, and their assembly.

Pages with equal payloads share one response record, of the largest page id; the others get revisit
records that refer to it. Archives are WARC 1.1 files, written by Spark's text writer (so to any file
system Spark can write to), gzip-compressed. The reader takes whole archives by Spark's binaryFile source,
inflates them as a stream and frames records by Content-Length; it checks each payload against
the record's digest. Assembly joins the three records of a capture through WARC-Concurrent-To and
emits one nested row.

Defined results: null html is an empty payload; null page ids are kept; rows that repeat page id and
payload are numbered, and the first is the response; line breaks in URLs are percent-encoded, a null URL
has no target; a request without response makes a capture without one; extra columns are ignored; an
empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SALTS, bucket, cut

CRLF = "\r\n"
#: RFC 4648 base32 digits, beside those of base 32 numbers.
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Records of a file at most, and bytes of payload, about: the reader takes files whole.
RECORDS_PER_FILE, FILE_BYTES = 100_000, 128 << 20
BATCH_BYTES = 8 << 20
BATCH_RECORDS = 2_000
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, block string, payload binary"


def base32_sha1(data: Column) -> Column:
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _record(kind: str | Column, own: Column, target: Column, date: str, extra: Column, content_type: str, block: Column) -> Column:
    """The text of a record but for its last line break, which the writer adds."""
    head = _text("WARC/1.1\r\nWARC-Type: ", kind if isinstance(kind, Column) else F.lit(kind), "\r\nWARC-Record-ID: ", own, "\r\nWARC-Date: ", date, CRLF)
    uri = F.when(target.isNull(), "").otherwise(_text("WARC-Target-URI: ", target, CRLF))
    size = F.octet_length(block).cast("string")
    return _text(head, uri, extra, "Content-Type: ", content_type, "\r\nContent-Length: ", size, "\r\n\r\n", block, CRLF)


def plan_captures(pages: DataFrame, min_revisit_bytes: int, id_col: str, url_col: str, html_col: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Each page with payload, digest, copy (its number among equal rows), keeper (the response's page) and role."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("key"))
    equal = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    equal = equal.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    same = Window.partitionBy("key", "_salt", "page_id").orderBy("url")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0))).first()[0]
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // file_bytes))
    dealt = rows.withColumn("_salt", bucket(SALTS, "page_id")).repartition(files, "key", "_salt")  # the join below keeps this dealing
    out = dealt.join(equal.repartition(files, "key", "_salt").hint("merge"), ["key", "_salt"], "left").withColumn("copy", F.row_number().over(same))
    response = F.col("n").isNull() | (F.col("page_id").eqNullSafe(F.col("keeper")) & (F.col("copy") == 1))
    return out.select("page_id", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), "copy", "keeper", F.when(response, "response").otherwise("revisit").alias("role"))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the archives of all pages to the folder `path`; pages are shuffled once."""
    rows = plan_captures(pages, min_revisit_bytes, id_col, url_col, html_col)
    size = F.octet_length("payload").cast("string")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    stem = _text("<urn:capture:", name, ":", F.col("copy").cast("string"), ":", F.col("digest"), ":")
    ids = {k: _text(stem, k, ">") for k in ("request", "response", "metadata")}
    refers = _text("<urn:capture:", F.coalesce(F.col("keeper").cast("string"), F.lit("null")), ":1:", F.col("digest"), ":response>")
    head = _text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", size, "\r\n\r\n")
    revisit = F.col("role") == "revisit"
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("payload")))
    extra = _text("WARC-Concurrent-To: ", ids["request"], "\r\nWARC-Payload-Digest: sha1:", F.col("digest"), CRLF, F.when(revisit, _text("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: ", refers, CRLF)).otherwise(""))
    asked = _text("GET ", F.coalesce("url", F.lit("")), " HTTP/1.1\r\n\r\n")
    fields = _text("page_id: ", name, "\r\npayload_bytes: ", size, CRLF)
    records = F.array(
        _record("request", ids["request"], F.col("url"), date, F.lit(""), "application/http; msgtype=request", asked),
        _record(F.col("role"), ids["response"], F.col("url"), date, extra, "application/http; msgtype=response", block),
        _record("metadata", ids["metadata"], F.col("url"), date, _text("WARC-Concurrent-To: ", ids["response"], CRLF), "application/warc-fields", fields),
    )
    out = rows.select(F.explode(records).alias("value"))
    out.write.mode("errorifexists").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class WarcError(ValueError):
    pass


class _Stream:
    """Inflates an archive piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        if self.inflate is None:
            self.buffer += piece
            return True
        while len(piece):
            self.buffer += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
            if self.inflate.eof:  # members follow one another
                self.inflate = zlib.decompressobj(31)
        return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise WarcError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def head(self) -> bytes | None:
        """Up to the blank line; None at the end."""
        start = 0
        while (i := self.buffer.find(b"\r\n\r\n", start)) < 0:
            start = max(0, len(self.buffer) - 3)
            if not self._more():
                if self.buffer.strip():
                    raise WarcError("the archive ends inside a header")
                return None
        return self.take(i + 4)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    stream = _Stream(data)
    while (head := stream.head()) is not None:
        lines = head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        block = stream.take(int(headers["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise WarcError("a record does not end in two line breaks")
        yield headers, block


def _parse(with_payload: bool):
    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        declared = headers.get("warc-payload-digest", "").partition(":")[2] or None
        payload = size = None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size = len(payload)
            actual = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if declared and declared != actual:
                raise WarcError(f"{headers.get('warc-record-id')}: payload and digest differ")
            declared = actual
        text = None if kind == "response" else block.decode("utf-8", "replace")
        return headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), declared, size, text, payload if with_payload else None

    names = [x.split()[0] for x in RECORD.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names, dtype=object)
        return out.assign(payload_bytes=pd.array(list(out["payload_bytes"]), dtype="Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for data in b["content"]:
                for headers, block in parse_warc(bytes(data)):
                    rows.append(row(headers, block))
                    held += len(block)
                    if held > BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield frame(rows)
                        rows, held = [], 0
        yield frame(rows)

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each record of the archives in `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(_parse(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: request, response (or revisit) and metadata."""
    names = [c for c in records.columns]
    part = lambda kinds, name: records.where(F.col("record_type").isin(*kinds)).select(F.struct(*names).alias(name))
    request, response, metadata = part(["request"], "request"), part(["response", "revisit"], "response"), part(["metadata"], "metadata")
    joined = response.join(metadata, F.col("metadata.concurrent_to") == F.col("response.record_id"), "left")
    return joined.join(request, F.col("response.concurrent_to") == F.col("request.record_id"), "full")


def capture_table(captures: DataFrame) -> DataFrame:
    """Digest columns of captures written by write_warc()."""
    page = lambda record_id: F.expr(f"try_cast(split({record_id}, ':')[2] AS BIGINT)")
    fields = F.str_to_map(F.col("metadata.block"), F.lit(CRLF), F.lit(": "))
    size = F.coalesce(F.col("response.payload_bytes"), F.expr("0L") + F.try_element_at(fields, F.lit("payload_bytes")).cast("long"))
    return captures.select(page("response.record_id").alias("page_id"), size.alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), page("response.refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and assemble: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives are parsed once: their records, without payloads, are kept for the three sides of the assembly.
    """
    write_warc(pages, path, min_revisit_bytes)
    return capture_table(assemble(cut(read_warc(pages.sparkSession, path, with_payload=False))))
